"""Slide paths from files, folders and URIs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Suffixes of slide files.
SUFFIXES = [".svs", ".tiff", ".tif", ".ndpi", ".mrxs", ".vms", ".scn", ".bif"]


def resolve(paths: str | os.PathLike | list) -> list[str]:
    """Folders are searched for slide files, in order of their names; files and URIs are kept as given.

    Order and repeats of the input are kept.  A path that does not exist and a folder
    without slides are errors.
    """
    out: list[str] = []
    for p in [paths] if isinstance(paths, (str, os.PathLike)) else paths:
        text = str(p)
        if "://" in text or os.path.isfile(text):
            out.append(text)
        elif os.path.isdir(text):
            found = sorted(str(f) for f in Path(text).rglob("*") if f.is_file() and f.suffix.lower() in SUFFIXES)
            if not found:
                raise FileNotFoundError(f"no slide files in {text}")
            out += found
        else:
            raise FileNotFoundError(text)
    return out


def slide_paths(spark: SparkSession, paths) -> DataFrame:
    """``pos, path`` of :func:`resolve`."""
    return spark.createDataFrame(list(enumerate(resolve(paths))), "pos long, path string")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of slide files below a folder of any Hadoop file system, listed by Spark; contents are not read."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(SUFFIXES))
