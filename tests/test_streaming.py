import pytest
from pyspark.sql import functions as F

from patchloom.operators.schedule import order_key
from patchloom.streaming import positions as P


def run(df, path, check):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
    return q


def test_positions_survive_a_restart(spark, tmp_path):
    import time

    for end in (20, 50):
        q = run(P.positions(spark, step=8, end=end), str(tmp_path / "out"), str(tmp_path / "check"))
        began = time.time()
        while time.time() - began < 60:
            try:
                if spark.read.parquet(str(tmp_path / "out")).count() >= end:
                    break
            except Exception:
                pass
            time.sleep(0.3)
        q.stop()
    got = sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == list(range(50))


@pytest.mark.parametrize(("n", "per", "pool"), [(5, 3, 2), (3, 4, 8), (7, 1, 3)])
def test_draws_match_the_batch_order(spark, n, per, pool):
    k = spark.range(2 * n * per).withColumnRenamed("id", "k")
    got = P.draws(k, n, per, pool).orderBy("k").collect()
    assert [r.epoch for r in got] == [0] * n * per + [1] * n * per
    first = [(r.pos, r.draw) for r in got[: n * per]]
    d = spark.createDataFrame([(p, i) for p in range(n) for i in range(per)], "pos long, draw long")
    want = [(r.pos, r.draw) for r in d.orderBy(*order_key(F.col("pos"), F.col("draw"), pool, 1)).collect()]
    assert first == want


def test_coordinates_depend_on_the_draw_alone(spark):
    s = spark.createDataFrame([(0, "a", 1000, 800), (1, "b", 100, 100)], "pos long, path string, width int, height int")
    k = spark.range(20).withColumnRenamed("id", "k")
    a = P.coordinates(P.draws(k, 2, 5, 2), s, 256)
    assert a.filter("path = 'b'").isEmpty() and a.count() == 10
    again = P.coordinates(P.draws(k.repartition(5), 2, 5, 2), s, 256)
    assert sorted((r.k, r.x, r.y) for r in a.collect()) == sorted((r.k, r.x, r.y) for r in again.collect())


def test_streamed_coordinates_have_tissue(spark, slides, full_masks):
    half = full_masks.withColumn("cells", F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: (i % 100 < 50).cast("int")))
    s = slides.filter("width > 1000").select((F.when(F.col("path").like("%0%"), 0).otherwise(1)).cast("long").alias("pos"), "path", "width", "height")
    k = spark.range(40).withColumnRenamed("id", "k")
    rows = P.coordinates(P.draws(k, 2, 10, 2), s, 256, half, threshold=0.9).collect()
    assert len(rows) == 40 and all(r.tissue_fraction >= 0.9 and r.x < 2048 for r in rows)
    stream = P.coordinates(P.draws(P.positions(spark, step=8, end=16), 2, 10, 2), s, 256, half)
    assert stream.isStreaming and {"x", "y", "tissue_fraction"} <= set(stream.columns)


def test_live_metrics(spark):
    stream = spark.readStream.format("rate").load().select(
        F.col("timestamp").alias("ts"), F.lit(1).alias("data_wait_ns"), F.lit(2).alias("wall_ns"), F.lit(3).alias("patches"),
    )
    assert P.live_metrics(stream).isStreaming
