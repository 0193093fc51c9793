"""Cutting lineage through tables in the cluster's shared folder.

Long plans and driver loops write their intermediate tables as Parquet below
``spark.checkpoint.dir`` and read them again.  The files outlive executors, so
a lost executor costs a re-read and not the whole lineage.  Only a local session
(tests) that names no such folder gets one; on a cluster, whose executors would each
write to a disk of their own, that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one if it is unset in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="patchloom-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/patchloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no plan will read again."""
    names = {part for df in frames for f in df.inputFiles() for part in f.split("/") if part.startswith("patchloom-")}
    for spark, path in list(_written):
        if path.rsplit("/", 1)[1] in names:
            _delete(spark, path)
            _written.remove((spark, path))


@contextmanager
def scratch():
    """Tables made by :func:`cut` inside the block are deleted at its end: run what reads them inside."""
    have = len(_written)
    try:
        yield
    finally:
        made = _written[have:]
        del _written[have:]
        for spark, path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:
            pass
    _written.clear()
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)
