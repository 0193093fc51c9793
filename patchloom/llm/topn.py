"""The N best items of every group, by bisection in all groups at once.

Items are ordered by the code (score, identifier): the higher score first, among
equal scores the smaller identifier.  Scores enter it as 64-bit integers in the order
of the doubles (:func:`order_code`), identifiers as they are.  A pass counts, for every
group still open, the items above ``WAYS - 1`` midpoints between the group's smallest and
largest code, which is as many bisections as ``WAYS`` has bits.  Items above the midpoint
beyond which there are fewer than N are in, those below the next are out, and only
those between remain for the next pass.  Midpoints are multiples of a power of two, by
shifts of the integers, so the smallest and the largest code never fall together and every
pass narrows every open interval at least ``WAYS / 4``-fold: 128 bits take at most ``PASSES``.
Counts are combined before the shuffle and no task ever holds a group.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import pick
from ..materialize import cut, drop
from ..ranking import grouped_prefix_sum
from ..skew import hot_buckets, repeat_one, split_many

WAYS = 64
#: 64 bits of a score and 64 of an identifier, at least 4 of them a pass, and one pass to begin with.
PASSES = 33


def order_code(s: Column) -> Column:
    """A double that is not NaN as a 64-bit integer of the same order: its bits, those of the magnitude negated below 0.

    -0.0 and 0.0 are equal.  Exponent and mantissa come from exact powers of two.
    """
    endless = F.abs(s) == float("inf")
    a = F.when(endless, F.lit(1.0)).otherwise(F.abs(s))
    # The logarithm may be off by one beside a power of two.
    near = F.greatest(F.floor(F.log2(a)), F.lit(-1074).cast("long"))
    power = lambda e: F.pow(F.lit(2.0), e)
    e = near + F.when(a >= power(near + 1), 1).when(a < power(near), -1).otherwise(0)
    e = F.greatest(e, F.lit(-1022).cast("long"))
    bits = (e + 1022) * F.lit(1 << 52) + (a / power(e) * F.lit(float(1 << 52))).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(endless, F.lit(0x7FF << 52)).otherwise(bits)
    return F.when(s < 0, -bits).otherwise(bits)


def _code(s: float) -> int:
    """:func:`order_code` of a single number."""
    bits = struct.unpack("<q", struct.pack("<d", abs(s)))[0]
    return -bits if s < 0 else bits


def _shift(low: Column, high: Column) -> Column:
    """By how many bits to shift so that ``high`` lies fewer than ``WAYS`` steps above ``low``, without overflow."""
    half = F.shiftright(high, 1) - F.shiftright(low, 1)
    more = F.greatest(F.ceil(F.log2((half.cast("double") + 1) / (WAYS - 1))), F.lit(0))
    return F.when(half < WAYS // 2 - 1, 0).otherwise(more + 1).cast("int")


def _shift_of(low: int, high: int) -> int:
    half = (high >> 1) - (low >> 1)
    return 0 if half < WAYS // 2 - 1 else 1 + max(0, math.ceil(math.log2((float(half) + 1) / (WAYS - 1))))


def _shifted(value: Column, shift: Column) -> Column:
    return F.call_function("shiftright", value, shift)


def top_n(df: DataFrame, group: str, score: str, id: str, n: int, *, low: float | None = None, high: float | None = None) -> DataFrame:
    """``group, id, score, rank`` of the ``n`` best items of each group, or of all if there are fewer.

    Rows with a null group or identifier name no item; a null or NaN score, or one outside
    ``[low, high]``, does not count; infinite scores do.  An item delivered twice in a group
    counts once, with its highest score.  Ties go to the smaller identifier, so the result
    is the same for any partitioning.  Other columns play no part, whatever their names; an empty table has no items.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    own = pick(df, g=group, id=id, s=score)
    s = F.col("s").cast("double")
    good = F.col("g").isNotNull() & F.col("id").isNotNull() & s.isNotNull() & ~F.isnan(s)
    for limit, over in ((low, s.__ge__), (high, s.__le__)):
        if limit is not None:
            good = good & over(F.lit(float(limit)))
    rows = own.filter(good).select("g", "id", s.alias("s"))
    # Names of groups may be long; their hashes go through the shuffles, unless two names share one.
    names = cut(rows.select("g", F.xxhash64("g").alias("key")).distinct())
    if not names.groupBy("key").count().filter("count > 1").isEmpty():
        names = names.withColumn("key", F.col("g"))
        rows = rows.withColumn("key", F.col("g"))
    else:
        rows = rows.withColumn("key", F.xxhash64("g"))
    items = rows.select(F.col("key").alias("g"), "id", "s").groupBy("g", "id").agg(F.max("s").alias("s"))
    kind = own.schema["id"].dataType
    integral = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    items = items.select("g", "s", F.col("id").cast("long").alias("i")) if integral else _numbered(items)
    items = cut(items)
    ls, hs, li, hi = items.agg(F.min("s"), F.max("s"), F.min("i"), F.max("i")).first()
    if ls is None:
        return _named(items.limit(0), names, group, score, id, kind if integral else None)
    # The first pass has the same midpoints for every group, so the items need not be joined to anything.
    # They are evenly spaced in the score where it has finite ends, which is a coarser order of the same code.
    if ls < hs and math.isfinite(hs - ls):
        b = F.floor((F.col("s") - F.lit(ls)) / F.lit(hs - ls) * WAYS)
    elif ls < hs:
        k = _shift_of(_code(ls), _code(hs))
        b = F.shiftright(order_code(F.col("s")), k) - F.lit(_code(ls) >> k)
    else:
        k = _shift_of(li, hi)
        b = F.lit(hi >> k) - F.shiftright("i", k)
    open_rows = items.select("*", F.least(F.lit(WAYS - 1), b).cast("int").alias("b"), F.lit(n).cast("long").alias("need"))
    chosen = []
    for _ in range(PASSES):
        counts = open_rows.groupBy("g", "b").agg(
            F.max("need").alias("need"), F.count("*").alias("k"), F.min("s").alias("ls"), F.max("s").alias("hs"), F.min("i").alias("li"), F.max("i").alias("hi")
        )
        # At most WAYS rows a group from here on.
        down = Window.partitionBy("g").orderBy(F.desc("b"))
        counts = counts.withColumn("above", F.sum("k").over(down) - F.col("k")).withColumn("all", F.sum("k").over(Window.partitionBy("g")))
        counts = counts.filter(F.col("above") < F.col("need"))
        counts = counts.withColumn("last", F.row_number().over(Window.partitionBy("g").orderBy("b")) == 1)
        edge = counts.filter("last").select(
            "g", "all", F.col("b").alias("at"), (F.col("need") - F.col("above")).alias("left"), "k", order_code(F.col("ls")).alias("lc"),
            order_code(F.col("hs")).alias("hc"), "li", "hi",
        )
        if not chosen:
            # Groups only get smaller: those of many items are known from the first pass.
            edge = cut(edge)
            hot = hot_buckets(edge, "g", "all")
        # What the next pass needs of a group: the shift and the shifted end of its interval.
        by_score = F.col("hc") > F.col("lc")
        shift = F.when(by_score, _shift(F.col("lc"), F.col("hc"))).otherwise(_shift(F.col("li"), F.col("hi")))
        ends = edge.withColumn("by_score", by_score).withColumn("shift", shift)
        ends = ends.withColumn("end", _shifted(F.when(F.col("by_score"), F.col("lc")).otherwise(F.col("hi")), F.col("shift")))
        # One row a group meets its items; groups of many items meet it in parts, so that no task gets a whole group.
        one = repeat_one(ends.select("g", "at", "left", "k", "by_score", "shift", "end"), "g", hot)
        many = split_many(open_rows.drop("need"), "g", F.col("i"), hot)
        step = many.join(one, ["g", "_part"]).filter(F.col("b") >= F.col("at"))
        step = cut(
            step.select(
                "g", "s", "i", ((F.col("b") > F.col("at")) | (F.col("k") <= F.col("left"))).alias("in"), "left", "by_score", "shift", "end",
            )
        )
        chosen.append(step.filter("in").select("g", "s", "i"))
        rest = step.filter("not in")
        if rest.isEmpty():
            break
        value = F.when(F.col("by_score"), order_code(F.col("s"))).otherwise(F.col("i"))
        gap = _shifted(value, F.col("shift")) - F.col("end")
        b = F.when(F.col("by_score"), gap).otherwise(-gap)
        open_rows = rest.select("g", "s", "i", F.least(F.lit(WAYS - 1), b).cast("int").alias("b"), F.col("left").alias("need"))
    else:
        raise RuntimeError("the intervals did not close")
    result = chosen[0]
    for more in chosen[1:]:
        result = result.unionByName(more)
    if not integral:
        result = result.join(items.select("g", "i", "id"), ["g", "i"])
    else:
        drop(items)
    return _named(result, names, group, score, id, kind if integral else None)


def _numbered(items: DataFrame) -> DataFrame:
    """Identifiers that are no integers, numbered in their order."""
    ids = cut(items.select("id").distinct().withColumn("one", F.lit(1)))
    return items.join(grouped_prefix_sum(ids, [], ["id"], "one", before="i").drop("one"), "id").select("g", "s", "i", "id")


def _named(rows: DataFrame, names: DataFrame, group: str, score: str, id: str, integral) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("s"), "i"))  # at most n rows a group
    own = F.col("i").cast(integral) if integral else F.col("id")
    ranked = rows.withColumnRenamed("g", "key").withColumn("rank", rank)
    return ranked.join(names, "key").select(F.col("g").alias(group), own.alias(id), F.col("s").alias(score), "rank")
