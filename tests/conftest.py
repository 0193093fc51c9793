from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from patchloom.session import session

    s = session(4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def slides(spark):
    levels = [(0, 4096, 4096, 1.0), (1, 2048, 2048, 2.0), (2, 1024, 1024, 4.0)]
    rows = [
        ("memory://slide_0.svs", 4096, 4096, 0.25, "fake", levels),
        ("memory://slide_1.svs", 4096, 4096, None, None, levels),
        ("memory://tiny.svs", 200, 200, 0.25, "fake", [(0, 200, 200, 1.0)]),
    ]
    ddl = "path string, width int, height int, mpp double, vendor string, levels array<struct<level:int,width:int,height:int,downsample:double>>"
    return spark.createDataFrame(rows, ddl)


@pytest.fixture
def full_masks(spark, slides):
    """100 x 100 cells, all tissue."""
    from pyspark.sql import functions as F

    return slides.select(
        "path", F.lit(100).alias("mask_w"), F.lit(100).alias("mask_h"), (F.greatest("width", "height") / 100).alias("downsample"),
        F.array_repeat(F.lit(1), 10000).alias("cells"),
    )
