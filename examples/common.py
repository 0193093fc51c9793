"""Slides for the examples: files of a folder if one is given, else synthetic ones."""

from __future__ import annotations

import argparse

from patchloom.session import session
from patchloom.sources.paths import slide_paths
from patchloom.sources.readers import OpenSlideReader, Stained
from patchloom.sources.slides import properties


def arguments(**more) -> argparse.Namespace:
    p = argparse.ArgumentParser()
    p.add_argument("--slides", help="a folder of slide files; needs the library openslide")
    p.add_argument("--cores", type=int, default=4)
    for name, value in more.items():
        p.add_argument(f"--{name}", type=type(value), default=value)
    return p.parse_args()


def open_slides(args: argparse.Namespace, n: int = 6):
    """The session, the table of slides that can be opened, and their reader."""
    spark = session(args.cores)
    make = OpenSlideReader if args.slides else Stained
    paths = slide_paths(spark, args.slides) if args.slides else spark.createDataFrame([(f"memory://slide_{i}.svs",) for i in range(n)], "path string")
    return spark, properties(paths.select("path"), make).filter("error is null").drop("error"), make
