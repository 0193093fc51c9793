"""Tables the queries run on, derived from the given ones by arithmetic that SQL can repeat.

There are no slide files, so masks are discs of a size that depends on the path, and
pixels are embeddings read as planes of 8 x 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rng import bits, bits_sql
from .operators.geometry import distinct_slides
from .operators.masks import mask_downsample

MASK = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slides(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_slides(table(spark, folder, "slides"))


def mask_cells(s: DataFrame) -> DataFrame:
    n = F.sequence(F.lit(0), F.lit(MASK - 1))
    c = s.select(
        "path", mask_downsample(F.col("width"), F.col("height"), MASK, MASK).alias("downsample"), (bits("path") % 20 + 30).alias("_r"),
        F.explode(n).alias("my"),
    )
    c = c.select("*", F.explode(n).alias("mx"))
    return c.select("path", "downsample", "my", "mx", (((F.col("mx") - 7.5) ** 2 + (F.col("my") - 7.5) ** 2) < F.col("_r")).alias("tissue"))


def masks(s: DataFrame) -> DataFrame:
    """One row for each slide, made inside the row: no shuffle."""
    cell = lambda i: ((i % MASK - 7.5) * (i % MASK - 7.5) + (F.floor(i / MASK) - 7.5) * (F.floor(i / MASK) - 7.5) < F.col("_r")).cast("int")
    c = s.select(
        "path", mask_downsample(F.col("width"), F.col("height"), MASK, MASK).alias("downsample"), (bits("path") % 20 + 30).alias("_r"),
    )
    return c.select(
        "path", F.lit(MASK).alias("mask_w"), F.lit(MASK).alias("mask_h"), "downsample",
        F.transform(F.sequence(F.lit(0), F.lit(MASK * MASK - 1)), cell).alias("cells"),
    )


def plane() -> Column:
    return F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 256 + 128))).cast("int"))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``img_id, i, red, green, blue``: red is the plane, green and blue the same shifted by 21 and 42."""
    p = table(spark, folder, "embeddings").select(F.col("vec_id").alias("img_id"), plane().alias("p"))
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    at = lambda k: F.get("p", (F.col("i") + k) % 64)
    return p.select("img_id", "i", at(0).alias("red"), at(21).alias("green"), at(42).alias("blue"))


SLIDES = "sl AS (SELECT DISTINCT path, width, height, mpp, vendor, levels FROM slides WHERE path IS NOT NULL AND width > 0 AND height > 0 AND len(levels) > 0)"
LEVELS = "lv AS (SELECT path, width, height, mpp, l.level AS level, l.downsample AS ds FROM (SELECT path, width, height, mpp, unnest(levels) AS l FROM sl))"
CELLS = f"""cells AS (
  SELECT path, greatest(width / {MASK}::DOUBLE, height / {MASK}::DOUBLE) AS downsample, mx::INT AS mx, my::INT AS my,
    (mx - 7.5::DOUBLE) ** 2 + (my - 7.5::DOUBLE) ** 2 < {bits_sql('path')} % 20 + 30 AS tissue
  FROM sl, range({MASK}) a(mx), range({MASK}) b(my))"""
PIXELS = """px AS (
  SELECT vec_id AS img_id, i::INT AS i, p[i + 1] AS red, p[(i + 21) % 64 + 1] AS green, p[(i + 42) % 64 + 1] AS blue
  FROM (SELECT vec_id, list_transform(embedding, lambda v: least(255, greatest(0, floor(v::DOUBLE * 256 + 128)))::INT) AS p FROM embeddings), range(64) r(i))"""
HSV = """hsv AS (
  SELECT img_id, i, red, green, blue, v, CASE WHEN v = 0 THEN 0 ELSE floor(d * 255 / v + 0.5) END::INT AS s,
    CASE WHEN d = 0 THEN 0 ELSE floor(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END + 0.5)::INT % 180 END AS h
  FROM (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = red THEN (green - blue) * 30 / d WHEN v = green THEN (blue - red) * 30 / d + 60 ELSE (red - green) * 30 / d + 120 END AS h0
    FROM (SELECT *, greatest(red, green, blue) AS v, (greatest(red, green, blue) - least(red, green, blue))::DOUBLE AS d FROM px)))"""
