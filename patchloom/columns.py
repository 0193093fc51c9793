"""Columns taken by place, so that other columns of the same name do no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns (``new=old``) alone.

    A name is looked up as it is spelled, the first of several, and only then in any
    letter case; other columns play no part.  A name that is missing is an error.
    """
    places, lower = {}, [c.lower() for c in df.columns]
    for new, old in names.items():
        if old.lower() not in lower:
            raise ValueError(f"there is no column {old!r} among {df.columns}")
        places[new] = df.columns.index(old) if old in df.columns else lower.index(old.lower())
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(new) for new, i in places.items()])
