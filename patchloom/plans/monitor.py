"""Timing of batch loops and of whole configurations."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats

STEPS = "step long, data_wait_ns long, compute_ns long, wall_ns long, patches int"


class MonitoredLoader:
    """Passes batches on and notes how long each was waited for and worked on.

    ``metrics`` gets the numbers of the last ``every`` steps as they are complete;
    :meth:`log` is the table of all steps for :func:`stats.loader_metrics`.
    """

    def __init__(self, batches: Iterable[dict], every: int = 50, metrics: Callable[[dict], None] | None = None):
        if every < 1:
            raise ValueError("every must be at least 1")
        self.batches, self.every, self.metrics, self.rows = batches, every, metrics, []

    def __iter__(self) -> Iterator[dict]:
        it = iter(self.batches)
        while True:
            began = time.perf_counter_ns()
            try:
                batch = next(it)
            except StopIteration:
                return
            got = time.perf_counter_ns()
            yield batch
            done = time.perf_counter_ns()
            self.rows.append((len(self.rows), got - began, done - got, done - began, stats.batch_size(batch)))
            if self.metrics and len(self.rows) % self.every == 0:
                self.metrics(summary(self.rows[-self.every :]))

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STEPS)


def summary(rows: list[tuple]) -> dict[str, float]:
    """The metrics of :func:`stats.loader_metrics` for steps held in memory; empty for none."""
    if not rows:
        return {}
    n = len(rows)
    wait, compute, wall, patches = (sum(r[i] for r in rows) for i in range(1, 5))
    sec = max(wall / 1e9, 1e-9)
    return {
        "data_wait_ms": wait / 1e6 / n, "compute_ms": compute / 1e6 / n, "step_ms": wall / 1e6 / n, "data_fraction": wait / max(wall, 1),
        "batches_per_sec": n / sec, "patches_per_sec": patches / sec,
    }


class PeakMemory:
    """Largest resident size of a process tree while the block runs, in bytes."""

    def __init__(self, pid: int | None = None, interval: float = 0.1):
        self.pid, self.interval, self.peak = pid, interval, 0

    def _size(self) -> int:
        import psutil

        top = psutil.Process(self.pid)
        total = 0
        for p in [top, *top.children(recursive=True)]:
            try:
                total += p.memory_info().rss
            except psutil.Error:
                pass
        return total

    def __enter__(self) -> PeakMemory:
        self._stop = threading.Event()

        def poll() -> None:
            while not self._stop.is_set():
                self.peak = max(self.peak, self._size())
                self._stop.wait(self.interval)

        self._thread = threading.Thread(target=poll, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()


def benchmark(make: Callable[..., DataFrame], n_slides: int, world_size: int = 1, **options) -> list[dict]:
    """Patches a second of ``make(**configuration)`` for each configuration of the sweep.

    The plan is run into a sink that keeps nothing, once to warm up and once timed;
    the best configuration comes first.
    """
    out = []
    for config in stats.sweep(n_slides, world_size, **options):
        df = make(**config)
        df.write.format("noop").mode("overwrite").save()
        with PeakMemory() as memory:
            began = time.perf_counter()
            n = make(**config).count()
            seconds = time.perf_counter() - began
        out.append(config | {"patches": n, "seconds": seconds, "patches_per_sec": n / max(seconds, 1e-9), "peak_rss": memory.peak})
    return sorted(out, key=lambda r: -r["patches_per_sec"])


def throughput(
    make: Callable[..., Iterable[dict]], slides: DataFrame, world_size: int = 1, *, warmup: int = 10, measure: int = 50, order: str = "path",
    **options,
) -> DataFrame:
    """Batches a second of ``make(slides, **configuration)`` for each configuration of the sweep, by ranks that run side by side.

    Each rank has every ``world_size``-th slide and takes batches from an iterable of its own, which should not end (``cycle=True``):
    ``warmup`` batches that do not count, then ``measure`` that are timed.  The result is that of
    :func:`.stats.benchmark_summary` for each configuration, the best first; none if there are fewer slides than ranks.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..operators.geometry import rank_partition

    if measure < 1 or warmup < 0:
        raise ValueError("measure must be at least 1 and warmup not negative")
    spark, rows = slides.sparkSession, []
    configs = stats.sweep(slides.select(order).distinct().count(), world_size, **options)
    names = list(options)

    def one(rank: int, config: dict) -> list[tuple]:
        it, out = iter(make(rank_partition(slides, order, rank, world_size), **config)), []
        try:
            for i in range(warmup + measure):
                began = time.perf_counter()
                batch = next(it)
                if i >= warmup:
                    out.append((*config.values(), rank, (time.perf_counter() - began) * 1000, stats.batch_size(batch)))
        finally:
            if hasattr(it, "close"):
                it.close()
        return out

    for config in configs:
        with PeakMemory() as memory, ThreadPoolExecutor(world_size) as ranks:
            found = [r for part in ranks.map(lambda k: one(k, config), range(world_size)) for r in part]
        rows += [(*r, memory.peak) for r in found]
    kinds = [{int: "long", float: "double", bool: "boolean"}.get(type(v), "string") for v in (configs[0].values() if configs else [0] * len(names))]
    ddl = ", ".join([*[f"{n} {k}" for n, k in zip(names, kinds, strict=True)], "rank int", "batch_ms double", "patches long", "rss long"])
    measured = spark.createDataFrame(rows, ddl)
    return stats.benchmark_summary(measured, names, rss="rss").orderBy(F.desc("effective"))
