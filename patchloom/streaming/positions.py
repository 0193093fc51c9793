"""Endless cycles over slides as a replayable stream.

The stream's offset is a position k.  Epoch, slide and draw follow from (seed, k)
alone, so a batch can be replayed after a restart without any state; Spark hands
the last offset back to the reader, which therefore never goes backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.rng import uniform
from ..operators.masks import with_sums


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, start: int, step: int, end: int | None):
        self.start, self.step, self.end = start, step, end

    def initialOffset(self) -> dict:
        return {"k": self.start}

    def _rows(self, a: int, b: int):
        return iter([(k,) for k in range(a, b)])

    def read(self, start: dict):
        a = start["k"]
        b = a + self.step if self.end is None else min(a + self.step, self.end)
        return self._rows(a, b), {"k": b}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start["k"], end["k"])


class Positions(DataSource):
    """Options: ``start``, ``step`` (positions of a batch) and ``end`` (none: endless)."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def schema(self) -> str:
        return "k bigint"

    def simpleStreamReader(self, schema) -> _Reader:
        o = self.options
        return _Reader(int(o.get("start", 0)), int(o.get("step", 64)), int(o["end"]) if "end" in o else None)


def positions(spark: SparkSession, step: int = 64, end: int | None = None, start: int = 0) -> DataFrame:
    spark.dataSource.register(Positions)
    r = spark.readStream.format("positions").option("step", step).option("start", start)
    return (r.option("end", end) if end is not None else r).load()


def draws(k: DataFrame, n_slides: int, per_slide: int, pool: int, seed: int = 0) -> DataFrame:
    """``k, epoch, pos, draw`` of a round robin over ``pool`` open slides with ``per_slide`` draws each.

    Closed form: blocks of ``pool`` slides, the last block smaller.
    """
    if min(n_slides, per_slide, pool) < 1:
        raise ValueError("n_slides, per_slide and pool must be at least 1")
    full = n_slides * per_slide
    at = F.col("k") % full
    block = F.floor(at / (pool * per_slide))
    width = F.least(F.lit(pool), F.lit(n_slides) - block * pool)
    inside = at - block * pool * per_slide
    d = k.withColumn("epoch", F.floor(F.col("k") / full).cast("int"))
    return d.withColumn(
        "pos", (block * pool + inside % width).cast("long"),
    ).withColumn("draw", F.floor(inside / width).cast("long")).withColumn("seed", F.lit(seed))


def coordinates(
    draws_: DataFrame, slides: DataFrame, patch: int, masks: DataFrame | None = None, *, threshold: float = 0.4, retries: int = 50,
) -> DataFrame:
    """Uniform coordinates of streamed draws; ``slides`` has ``pos, path, width, height``.

    With ``masks`` the first of ``retries`` positions that has tissue, as in the batch sampler; a
    draw that finds none yields nothing.  Both tables are static, so the stream keeps no state.
    """
    from ..operators.sampling import attempt

    s = slides.filter((F.col("width") >= patch) & (F.col("height") >= patch))
    if masks is None:
        j = draws_.join(s, "pos")
        pick = lambda lane, room: F.floor(uniform("seed", "epoch", "path", "draw", F.lit(lane)) * (room + 1)).cast("int")
        return j.withColumn("x", pick("x", F.col("width") - patch)).withColumn("y", pick("y", F.col("height") - patch)).drop("seed")
    j = draws_.join(with_sums(s, masks).hint("merge"), "pos")
    found = attempt("seed", "epoch", F.col("draw"), F.lit(patch), retries, threshold)
    j = j.withColumn("_f", found).drop("seed", "_sat", "mask_w", "mask_h", "downsample")
    return j.select("*", "_f.x", "_f.y", "_f.tissue_fraction").drop("_f").filter("x is not null")


def live_metrics(steps: DataFrame, late: str = "1 minute", window: str = "10 seconds") -> DataFrame:
    """Patches and waiting time by wall-clock window of a stream of steps (``ts, data_wait_ns, wall_ns, patches``)."""
    return (
        steps.withWatermark("ts", late)
        .groupBy(F.window("ts", window))
        .agg(
            F.count("*").alias("steps"), F.sum("patches").alias("patches"),
            (F.sum("data_wait_ns") / F.greatest(F.sum("wall_ns"), F.lit(1))).alias("data_fraction"),
        )
    )
