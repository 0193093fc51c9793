import duckdb
import pytest
from pyspark.sql import functions as F

from patchloom import skew
from patchloom.columns import pick
from patchloom.functions import pixels, rng
from patchloom.materialize import cut, drop, scratch, shared_folder
from patchloom.ranking import grouped_prefix_sum


def test_rng_matches_a_second_engine(spark):
    df = spark.range(500).select("id", rng.uniform(7, "id", F.lit("x")).alias("u"))
    want = dict(duckdb.sql(f"SELECT id, {rng.uniform_sql(7, 'id', repr('x'))} FROM range(500) t(id)").fetchall())
    got = {r.id: r.u for r in df.collect()}
    assert got == want and 0.45 < sum(got.values()) / 500 < 0.55


def test_prefix_sums_of_any_partitioning(spark):
    import random

    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None, ""]), i, rnd.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    want, seen = {}, {}
    for g, o, w in rows:
        want[o] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + w
    for n in (1, 7):
        got = grouped_prefix_sum(df, ["g"], ["o"], "w", total="t", partitions=n).collect()
        assert {r.o: r.before for r in got} == want and all(r.t == seen[r.g] for r in got) and len(got) == 400
    assert grouped_prefix_sum(df.limit(0), ["g"], ["o"], "w").isEmpty()
    assert sorted(r.before for r in grouped_prefix_sum(df, [], ["o"], F.lit(1)).collect()) == list(range(400))


def test_cut_keeps_rows_outside_the_lineage(spark):
    df = cut(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect() and shared_folder(spark) in df.inputFiles()[0]
    drop(df)
    with pytest.raises(Exception):
        df.collect()
    with scratch():
        inside = cut(spark.range(3))
        assert inside.count() == 3
    with pytest.raises(Exception):
        inside.collect()


def test_no_folder_of_its_own_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_hot_keys_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 50)
    many = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 40)).alias("k"), "id")
    one = many.select("k").distinct().withColumn("v", F.col("k") * 2)
    hot = skew.hot_buckets(many, "k")
    assert hot.count() == 1
    parts = skew.split_many(many, "k", F.col("id"), hot)
    j = parts.join(skew.repeat_one(one, "k", hot), ["k", "_part"])
    assert j.count() == 1000 and j.filter("v <> k * 2").isEmpty()
    assert parts.filter("k = 0").select("_part").distinct().count() > 5 and parts.filter("k = 1").select("_part").distinct().count() == 1
    for how in ("inner", "left"):
        again = skew.join_one(many, one.filter("k <> 5"), "k", F.col("id"), how)
        assert again.columns == ["k", "id", "v"] and again.count() == (1000 if how == "left" else 1000 - many.filter("k = 5").count())
    counted = many.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.hot_buckets(counted, "k", "n").collect() == hot.collect()
    monkeypatch.setattr(skew, "HOT", 5000)
    assert skew.hot_buckets(many, "k") is None


def test_the_whole_tree_is_collected():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    run = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=root, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stdout[-2000:]


def test_pick_by_place(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("id", "ID", "id")
    assert pick(df, x="id").first().x == 1 and pick(df, y="ID").first().y == 2
    assert pick(spark.range(1), x="ID").first().x == 0
    with pytest.raises(ValueError):
        pick(df, x="none")


def test_pixels_match_numpy(spark):
    import numpy as np

    from patchloom.operators.images import to_gray, to_hsv

    r = np.random.default_rng(0).integers(0, 256, (300, 3))
    df = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(r)], "i int, r int, g int, b int")
    h, s, v = pixels.hsv(F.col("r"), F.col("g"), F.col("b"))
    got = {
        x.i: (x.h, x.s, x.v, x.y) for x in df.select(
            "i", h.alias("h"), s.alias("s"), v.alias("v"), pixels.gray(F.col("r"), F.col("g"), F.col("b")).alias("y"),
        ).collect()
    }
    image = r.astype(np.uint8).reshape(1, -1, 3)
    want = np.concatenate([to_hsv(image)[0], to_gray(image)[0][:, None]], 1)
    assert [got[i] for i in range(300)] == [tuple(map(int, w)) for w in want]


def test_small_expressions(spark):
    df = spark.createDataFrame([([1, 2, 3, 9, 4, 5, 6, 9], "0.5"), ([7, 8, 9, 9], "x")], "a array<int>, t string")
    rows = df.select(pixels.drop_alpha(F.col("a")).alias("rgb"), pixels.try_double(F.col("t")).alias("d")).collect()
    assert rows[0].rgb == [1, 2, 3, 4, 5, 6] and rows[0].d == 0.5 and rows[1].d is None
    chw = df.select(pixels.chw(F.array(*map(F.lit, range(12))), 2, 2).alias("c")).first().c
    assert chw == [0, 3, 6, 9, 1, 4, 7, 10, 2, 5, 8, 11]
    with pytest.raises(ValueError):
        pixels.normalised(F.col("a"), 0, 0)
