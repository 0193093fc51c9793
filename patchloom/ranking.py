"""Distributed sort with per-partition counts.

A window with one sort per group sends every row of a group to one task.  Here
the rows are range-partitioned on ``(group, order)``, so that a large group is
spread over many tasks, each task sums its own part, and the totals of the
parts (one row per partition and group) give the offset of each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import cut


def partitions_for(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def grouped_prefix_sum(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    weight: str | Column,
    *,
    before: str = "before",
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the row's group, in ``order``.

    Adds ``before`` (0 for the first row) and, if asked, ``total`` of the group.
    ``order`` must be a total order inside each group for a reproducible result;
    nulls in ``group`` form a group of their own.  ``weight`` must be an exact
    type (integers), so that sums do not depend on the order of addition.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    n = partitions or partitions_for(df)
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group] + [F.isnull(g) for g in group]
    # The table is read twice, for the range bounds and for the sort, so it must not be recomputed.
    local = Window.partitionBy("_pid", *group).orderBy(*order)
    ranged = (
        df.withColumn("_w", weight.cast("long"))
        .repartitionByRange(n, *keys, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.sum("_w").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
    )
    ranged = cut(ranged)
    parts = ranged.groupBy("_pid", *group).agg(F.sum("_w").alias("_part"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_part").over(earlier), F.lit(0)))
    if total:
        parts = parts.withColumn(total, F.sum("_part").over(Window.partitionBy(*group)))
    renamed = parts.drop("_part").select(
        F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_offset", *([total] if total else [])
    )
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = ranged.join(renamed, on)
    return joined.withColumn(before, F.col("_local") + F.col("_offset")).drop(
        "_w", "_pid", "_local", "_p", "_offset", *[f"_g{i}" for i in range(len(group))]
    )
