"""A local session with the settings the engine is tuned for."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, wherever the driver was started; executors need it at the same path."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    # Spark runs a worker for each core; libraries inside must not start threads of their own.
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        env.setdefault(name, "1")
    # Arrays of an image's size come from the heap again and again, not each as new pages from the system.
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(32 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(64 << 20))
    return spark


def session(cpus: int | str = 8, memory: str = "8g", partitions: int | None = None, **conf: str) -> SparkSession:
    """A ``local[cpus]`` session; on a cluster make the session yourself."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("patchloom")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions or cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return reachable(builder.getOrCreate())
