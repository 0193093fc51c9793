"""Exact percentiles for each group, by a distributed sort with counts of its partitions.

The values of a group are summarised as (value, count); summaries of separate
days or partitions are combined by adding counts, without loss.  To look up a
percentile the summaries are sorted over all tasks, the counts of the partitions
give each partition's offset in its groups, and the two order statistics beside
the wanted position are interpolated.  The error is 0; with ``resolution`` values
are first rounded to its multiples, which bounds both the size of a summary and
the error, by half the resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import pick
from ..materialize import cut
from ..ranking import grouped_prefix_sum


def summarise(df: DataFrame, group: list[str], value: str, *, weight: str | None = None, resolution: float | None = None) -> DataFrame:
    """``*group, value, n``: how often each value occurs in each group.

    Null and NaN values do not count; null group values form groups of their own.
    """
    df = pick(df, **{g: g for g in group}, _v=value, **({"_n": weight} if weight else {}))
    v = F.col("_v").cast("double")
    good = v.isNotNull() & ~F.isnan(v)
    if resolution:
        v = F.round(v / F.lit(resolution)) * F.lit(resolution)
    n = F.sum("_n") if weight else F.count("*")
    # Adding 0.0 turns -0.0 into 0.0, which is one value in the order.
    return df.filter(good).select(
        *group, (v + F.lit(0.0)).alias("value"), *(["_n"] if weight else []),
    ).groupBy(*group, "value").agg(n.cast("long").alias("n"))


def combine(summaries: DataFrame, group: list[str]) -> DataFrame:
    """One summary of the rows of several."""
    return summaries.groupBy(*group, "value").agg(F.sum("n").cast("long").alias("n"))


def percentiles(summary: DataFrame, group: list[str], at: list[float]) -> DataFrame:
    """``*group, n_values, p, percentile`` for each ``p`` of ``at`` (0 to 1), interpolated linearly.

    Infinite values take part: between a finite and an infinite neighbour the percentile is the infinite
    one, between the two infinities it is NaN.  An empty summary has no rows.
    """
    if not at or any(not 0 <= p <= 1 for p in at):
        raise ValueError("percentiles lie between 0 and 1")
    placed = grouped_prefix_sum(cut(summary), group, ["value"], "n", before="before", total="total")
    last = F.col("before") + F.col("n") - 1

    def near_to(p):
        """Whether the row holds one of the two order statistics beside the position of ``p``."""
        at_ = (F.col("total") - 1) * p
        return (F.col("before") <= F.ceil(at_)) & (last >= F.floor(at_))

    # Most rows hold none, so they are left out before any is repeated.
    wanted = F.filter(F.array(*[F.lit(float(p)) for p in at]), near_to)
    placed = placed.withColumn("_p", wanted).filter(F.size("_p") > 0).withColumn("p", F.explode("_p"))
    position = (F.col("total") - 1) * F.col("p")
    holds = lambda k: (F.col("before") <= k) & (k <= last)
    lower, upper = F.floor(position), F.ceil(position)
    near = placed.groupBy(*group, "p").agg(
        F.max("total").alias("n_values"),
        F.max(F.when(holds(lower), F.col("value"))).alias("lower"),
        F.max(F.when(holds(upper), F.col("value"))).alias("upper"),
    )
    part = (F.col("n_values") - 1) * F.col("p")
    part = part - F.floor(part)
    low, high = F.col("lower"), F.col("upper")
    endless = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf"))
    between = F.when((part == 0) | (low == high), low).when(endless, low + high).otherwise(low + (high - low) * part)
    return near.select(*group, "n_values", "p", between.alias("percentile"))
