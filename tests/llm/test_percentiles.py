import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm.percentiles import combine, percentiles, summarise

AT = [0.0, 0.1, 0.5, 0.99, 1.0]


def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("hot", 3000), ("b", 7), ("one", 1), (None, 40)):
        v = rng.random(n)
        v[: n // 2] = np.round(v[: n // 2], 1)
        rows += [(g, int(i % 5), float(x)) for i, x in enumerate(v)]
    rows += [("hot", 1, None), ("hot", 1, float("nan")), ("none", 1, None)]
    return rows, spark.createDataFrame(rows, "g string, day int, v double")


def want(rows):
    by = {}
    for g, _, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    return {(g, p): (len(v), np.percentile(v, p * 100)) for g, v in by.items() for p in AT}


def check(df, expected, tol=1e-12):
    got = {(r.g, r.p): (r.n_values, r.percentile) for r in df.collect()}
    assert got.keys() == expected.keys()
    for k, (n, x) in expected.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(x, abs=tol)


def test_exact_for_any_partitioning(spark):
    rows, df = data(spark)
    for parts in (1, 8):
        check(percentiles(summarise(df.repartition(parts), ["g"], "v"), ["g"], AT), want(rows))


def test_days_combine_without_loss(spark):
    rows, df = data(spark)
    days = summarise(df, ["day", "g"], "v")
    parts = [days.filter(F.col("day") == i).drop("day") for i in range(5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = combine(whole.unionByName(p), ["g"])
    check(percentiles(whole, ["g"], AT), want(rows))


def test_resolution_bounds_the_error(spark):
    rows, df = data(spark)
    s = summarise(df, ["g"], "v", resolution=0.01)
    assert s.filter("g = 'hot'").count() <= 101
    check(percentiles(s, ["g"], AT), want(rows), tol=0.005 + 1e-9)


def test_weights_signs_and_empty(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 3), ("a", 5.0, 1), ("a", -0.0, 1), ("a", 0.0, 1)], "g string, v double, w int",
    ).select("*", F.lit("x").alias("V"))
    s = summarise(df, ["g"], "v", weight="w")
    assert s.filter("value = 0").collect()[0].n == 2 and s.count() == 3
    check(percentiles(s, ["g"], [0.5]), {("a", 0.5): (6, 1.0)})
    assert percentiles(summarise(df.limit(0), ["g"], "v"), ["g"], [0.5]).isEmpty()
    with pytest.raises(ValueError):
        percentiles(s, ["g"], [1.5])


def test_infinite_values(spark):
    inf = float("inf")
    rows = [("a", v) for v in (inf, inf, inf, 1.0)] + [("b", -inf), ("b", 2.0), ("b", 4.0)] + [("c", -inf), ("c", inf)]
    got = {(r.g, r.p): r.percentile for r in percentiles(summarise(spark.createDataFrame(rows, "g string, v double"), ["g"], "v"), ["g"], [0.0, 0.25, 0.5, 1.0]).collect()}
    assert [got["a", p] for p in (0.0, 0.25, 0.5, 1.0)] == [1.0, inf, inf, inf]
    assert [got["b", p] for p in (0.0, 0.25, 0.5, 1.0)] == [-inf, -inf, 2.0, 4.0]
    assert got["c", 0.0] == -inf and got["c", 1.0] == inf and got["c", 0.5] != got["c", 0.5]
