"""Joins of many rows to one row for each key, where a few keys may hold most of the rows.

Keys are counted in a fixed number of hash buckets, so what the driver sees is bounded
whatever the data.  Keys of a bucket with many rows are split into parts in
proportion to its rows, and their single row is repeated for each part; all other keys are left
as they are.  Both sides derive the parts from the key alone, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets in which keys are counted: the most rows the driver sees and broadcasts.
BUCKETS = 1 << 16
#: Rows of a bucket from which its keys are split, and rows wanted in a part.
HOT = 100_000
#: Most parts of a key.
PARTS = 1024


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def hot_buckets(counted: DataFrame, key: str, n: str | None = None) -> DataFrame | None:
    """``_bucket, _parts`` of the buckets with many rows; none if there are no such.

    ``counted`` has a row for each row, or, with ``n``, rows that stand for as many.
    """
    size = F.sum(n) if n else F.count("*")
    hot = counted.groupBy(_bucket(F.col(key)).alias("_bucket")).agg(size.alias("_n")).filter(F.col("_n") > HOT)
    parts = F.least(F.lit(PARTS), F.ceil(F.col("_n") / F.lit(HOT))).cast("int")
    rows = [tuple(r) for r in hot.select("_bucket", parts.alias("_parts")).collect()]
    return counted.sparkSession.createDataFrame(rows, "_bucket int, _parts int") if rows else None


def split_many(rows: DataFrame, key: str, by: Column, hot: DataFrame | None) -> DataFrame:
    """The rows with ``_part``, by a hash of ``by``; 0 for keys that are not split."""
    if hot is None:
        return rows.withColumn("_part", F.lit(0))
    j = rows.withColumn("_bucket", _bucket(F.col(key))).join(F.broadcast(hot), "_bucket", "left")
    part = F.pmod(F.xxhash64(by), F.col("_parts").cast("long")).cast("int")
    return j.withColumn("_part", F.coalesce(part, F.lit(0))).drop("_bucket", "_parts")


def repeat_one(one: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The single rows of the keys with ``_part``, once for each part."""
    if hot is None:
        return one.withColumn("_part", F.lit(0))
    j = one.withColumn("_bucket", _bucket(F.col(key))).join(F.broadcast(hot), "_bucket", "left")
    each = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return j.withColumn("_part", F.explode(each)).drop("_bucket", "_parts")


def join_one(many: DataFrame, one: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """``many`` (a written table: it is counted first) joined to the single rows of ``one`` by ``key``; hot keys in parts."""
    hot = hot_buckets(many, key)
    if hot is None:
        return many.join(one, key, how)
    return split_many(many, key, by, hot).join(repeat_one(one, key, hot), [key, "_part"], how).drop("_part")
