"""Samplers for SQL text: ``SELECT * FROM slides s, LATERAL grid_cells(s.width, s.height, 256, 256)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class GridCells:
    """Origins of a regular grid, row by row."""

    def eval(self, width: int, height: int, patch: int, stride: int) -> Iterator[tuple[int, int]]:
        if None in (width, height, patch, stride) or patch < 1 or stride < 1:
            return
        for y in range(0, height - patch + 1, stride):
            for x in range(0, width - patch + 1, stride):
                yield x, y


def register(spark: SparkSession) -> None:
    spark.udtf.register("grid_cells", udtf(GridCells, returnType="x int, y int"))
