"""From a file query to slides on disk: query, sample, summary, download, manifest."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..materialize import cut
from ..operators import metadata, sampling
from ..sources import datasource

log = logging.getLogger(__name__)


def query_slides(
    spark: SparkSession, url: str, cancer_types: list[str] | str | None = None, slide_type: str = "diagnostic",
    most_per_type: int | None = None, *, seed: int = 0, page: int = 10000,
) -> DataFrame:
    """The manifest of the slides that a file query finds: ``file_id, filename, file_size, cancer_type, md5sum, state``.

    ``url`` is the query's address, or a JSON file of one answer.  Pages are fetched by the tasks, one partition each.
    With ``most_per_type`` at most so many slides of each cancer type, drawn without replacement.  The answer is
    written once; files and GB by cancer type are logged, a query that finds nothing with a warning.
    """
    if most_per_type is not None and most_per_type < 1:
        raise ValueError("most_per_type must be at least 1")
    datasource.register(spark)
    source = spark.read.format("file_hits").option("url", url).option("size", page)
    found = metadata.hits(source.option("filters", json.dumps(metadata.query_filter(cancer_types, slide_type))).load())
    if most_per_type is not None:
        found = sampling.stratified(found, F.col("cancer_type"), most_per_type, uniform(seed, "file_id"), "file_id")
    found = cut(found)
    rows = metadata.summary(found).orderBy("is_total", "cancer_type").collect()
    if not rows or rows[-1]["n"] == 0:
        log.warning("the query found no slides")
    for r in rows:
        log.info("%s: %d slides, %.1f GB", "all" if r["is_total"] else r["cancer_type"], r["n"], r["gb"])
    return found


def download_slides(
    manifest: DataFrame, folder: str, fetch: Callable[[str, str], None], *, by_cancer: bool = True, skip_existing: bool = True,
    workers: int | None = None,
) -> DataFrame:
    """``dest, ok, error`` of each file that was not there with the right size; an error at the end if any failed.

    ``fetch(file_id, part)`` writes one file; ``workers`` tasks do so at a time.
    """
    spark = manifest.sparkSession
    if skip_existing:
        listed = existing(spark, folder)
        todo = metadata.missing(manifest, listed, folder, by_cancer)
    else:
        todo = manifest.withColumn("dest", metadata.destination(folder, by_cancer)).dropDuplicates(["dest"])
    todo = todo.repartition(workers or spark.sparkContext.defaultParallelism)
    done = cut(metadata.download(todo, fetch))
    failed = done.filter("not ok")
    n = failed.count()
    if n:
        first = failed.first()
        raise RuntimeError(f"{n} files failed, among them {first['dest']}: {first['error']}")
    return done


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """``dest, size`` of the files below a folder, none if there is no such folder; contents are not read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "dest string, size long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    local = F.regexp_replace("path", "^file:/+", "/") if "://" not in folder else F.col("path")
    return files.select(local.alias("dest"), F.col("length").alias("size"))
