"""Slide geometry: pyramid levels, grids, tissue under a footprint, shards.

Slides are rows ``path, width, height, mpp, vendor, levels``; ``levels`` holds
``level, width, height, downsample``.  Coordinates are level-0 pixels.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_slides(slides: DataFrame) -> DataFrame:
    """Repeated rows once.  Rows without a path, size or level describe no slide.

    Partitioned by path into a fixed number of parts: a few slides become very many
    coordinates, so the parts must not be merged for being small, and joins on the path
    need no further shuffle.
    """
    good = F.col("path").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & (F.size("levels") > 0)
    n = max(int(slides.sparkSession.conf.get("spark.sql.shuffle.partitions")), slides.sparkSession.sparkContext.defaultParallelism)
    return slides.filter(good).select("path", "width", "height", "mpp", "vendor", "levels").repartition(n, "path").distinct()


def downsample_of(level: Column | int) -> Column:
    """Downsample of a level, null if the slide has no such level."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.get(F.filter("levels", lambda x: x["level"] == level), 0)["downsample"]


def mpp_at(level: Column | int) -> Column:
    """Micrometres per pixel at a level; null if unknown."""
    return F.col("mpp") * downsample_of(level)


def best_level(target: Column | float) -> Column:
    """The level closest to the target mpp, the finer one on a tie, 0 if mpp is unknown."""
    t = F.lit(float(target)) if isinstance(target, (int, float)) else target
    by_gap = F.transform("levels", lambda x: F.struct(F.abs(F.col("mpp") * x["downsample"] - t).alias("gap"), x["level"].alias("level")))
    return F.when(F.col("mpp").isNull(), 0).otherwise(F.array_min(by_gap)["level"])


def coarsest_level(target: Column | float) -> Column:
    """The coarsest level that is no coarser than the target mpp, 0 if there is none or mpp is unknown."""
    t = F.lit(float(target)) if isinstance(target, (int, float)) else target
    fit = F.filter("levels", lambda x: x["downsample"] * F.col("mpp") <= t)
    return F.coalesce(F.array_max(F.transform(fit, lambda x: x["level"])), F.lit(0))


def grid(
    slides: DataFrame, patch_size: int = 256, level: Column | int = 0, stride: int | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """A row for each cell of a regular grid: ``path, x, y, level, patch_size, mpp``.

    Slides smaller than a patch have none.  A slide without that level is an error,
    as asked for by name; nulls in ``mpp`` stay null.
    """
    s = sized(slides, patch_size, level, stride)
    s = s.withColumn("y", F.explode(steps(F.col("height"))))
    s = s.withColumn("x", F.explode(steps(F.col("width"))))
    level = F.lit(level) if isinstance(level, int) else level
    return s.select(
        "path", "x", "y", level.alias("level"), F.lit(patch_size).alias("patch_size"), (F.col("mpp") * F.col("_ds")).alias("mpp"),
        F.col("_p").alias("footprint"), *(keep or []),
    )


def sized(slides: DataFrame, patch_size: int, level: Column | int, stride: int | None) -> DataFrame:
    """Slides large enough for a patch with ``_ds, _p, _s``: downsample of the level, and patch and stride in level-0 pixels."""
    if patch_size < 1 or (stride is not None and stride < 1):
        raise ValueError("patch_size and stride must be at least 1")
    s = slides.withColumn("_ds", downsample_of(level))
    s = s.withColumn("_p", (F.lit(patch_size) * F.col("_ds")).cast("int")).withColumn(
        "_s", F.greatest(F.lit(1), (F.lit(stride or patch_size) * F.col("_ds")).cast("int")),
    )
    return s.filter(F.col("_ds").isNull() | ((F.col("height") >= F.col("_p")) & (F.col("width") >= F.col("_p"))))


def steps(length: Column) -> Column:
    """Starts along one side of a slide of :func:`sized`.

    The error is raised where rows are made, so that slides filtered out before raise none.
    """
    lacks = F.raise_error(F.lit("a slide lacks the level of the grid")).cast("array<int>")
    return F.when(F.col("_ds").isNull(), lacks).otherwise(F.sequence(F.lit(0), length - F.col("_p"), F.col("_s")))


def rank_partition(slides: DataFrame, order: str, rank: int | None = None, world: int | None = None) -> DataFrame:
    """Every ``world``-th row in the given order, from ``rank`` on.

    Ranks that are not given are those of the environment (``RANK``, ``WORLD_SIZE``), or else one rank for all.
    A rank for which no row is left is an error.
    """
    rank = int(os.environ.get("RANK", 0)) if rank is None else rank
    world = int(os.environ.get("WORLD_SIZE", 1)) if world is None else world
    if world < 1 or not 0 <= rank < world:
        raise ValueError("rank must lie between 0 and world - 1")
    own = shards(slides, order, world).filter(F.col("shard") == rank).drop("shard")
    if own.isEmpty():
        raise RuntimeError(f"there are no rows for rank {rank} of {world}")
    return own


def shards(slides: DataFrame, order: str, world: int, workers: int = 1) -> DataFrame:
    """``shard`` (rank) and ``worker`` of each row, as by slicing the ordered list twice.

    Positions come from a distributed sort, so the list may be of any length.
    """
    from ..materialize import cut
    from ..ranking import grouped_prefix_sum

    placed = grouped_prefix_sum(cut(slides.withColumn("one", F.lit(1))), [], [order], "one", before="_i").drop("one")
    shard = (F.col("_i") % world).cast("int")
    placed = placed.withColumn("shard", shard)
    if workers > 1:
        placed = placed.withColumn("worker", (F.floor(F.col("_i") / world) % workers).cast("int"))
    return placed.drop("_i")


def view_centre(
    x: Column, y: Column, downsample: Column, patch_size: Column | int, view_downsample: Column, view_size: int | None = None,
) -> tuple[Column, Column]:
    """Where to read a view of another level so that it keeps the patch's centre; may be negative."""
    p = F.lit(patch_size) if isinstance(patch_size, int) else patch_size
    pv = F.lit(view_size) if view_size else p
    at = lambda v: F.rint(v + p * downsample / 2 - pv * view_downsample / 2).cast("long")
    return at(x), at(y)


def continuous_crop(target: Column, output_size: int) -> tuple[Column, Column, Column]:
    """Level, side at that level and side in level-0 pixels of a crop that shows ``output_size`` pixels at the target mpp."""
    level = coarsest_level(target)
    return level, *crop_at(target, downsample_of(level), output_size)


def crop_at(target: Column, downsample: Column, output_size: int) -> tuple[Column, Column]:
    """Side of that crop at its level and in level-0 pixels."""
    crop = F.greatest(F.lit(1.0), F.rint(F.lit(float(output_size)) * target / (F.col("mpp") * downsample))).cast("int")
    return crop, F.rint(crop * downsample).cast("int")


def magnification_histogram(patches: DataFrame) -> DataFrame:
    """Patches by mpp of two decimals; unknown mpp is its own, null, row."""
    return patches.groupBy(F.round("mpp", 2).alias("mpp")).agg(F.count("*").alias("n"))


def duplicate_paths(slides: DataFrame) -> DataFrame:
    return slides.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
