import random
import signal
import struct

import pytest
from pyspark.sql import functions as F

from patchloom import skew
from patchloom.llm.topn import _code, order_code, top_n


def brute(rows, n, low=None, high=None):
    groups = {}
    for g, s, i in rows:
        if g is None or i is None or s is None or s != s or (low is not None and s < low) or (high is not None and s > high):
            continue
        d = groups.setdefault(g, {})
        d[i] = max(d.get(i, s), s)
    return sorted(
        (g, i, s, k + 1) for g, d in groups.items() for k, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n])
    )


def rows_of(df):
    return sorted((r.g, r.i, r.s, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    rows = []
    for _ in range(3000):
        g = rnd.choice(["hot"] * 5 + ["b", "c", "", None])
        s = rnd.choice([rnd.random(), round(rnd.random(), 1), None, float("nan"), 1.5, -0.2, 0.0, -0.0])
        rows.append((g, s, rnd.choice([rnd.randrange(10**12), rnd.randrange(500), -rnd.randrange(9), None])))
    rows += rows[:500]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    for parts in (1, 9):
        assert rows_of(top_n(df.repartition(parts), "g", "s", "i", n, low=0.0, high=1.0)) == brute(rows, n, 0, 1)
    assert rows_of(top_n(df, "g", "s", "i", n)) == brute(rows, n)


def test_all_scores_tie_and_identifiers_are_extreme(spark):
    ids = [-(2**63), 2**63 - 1, 0, 1, 2**62, 2**62 + 1]
    rows = [("g", 0.5, i) for i in ids] + [("h", 1e-300, 1), ("h", 2e-300, 2), ("h", 1.0, 3), ("k", -1e299, 1), ("k", 1e299, 2)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    for n in (1, 2, 5):
        assert rows_of(top_n(df, "g", "s", "i", n)) == brute(rows, n)


def test_codes_are_the_bits_of_the_scores(spark):
    rnd = random.Random(0)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e308, 1.7976931348623157e308, float("inf"), -float("inf")]
    values += [s * 2.0**e * m for e in range(-1074, 1024, 7) for m in (1.0, 1.5, 1 - 2**-53, 1 + 2**-52) for s in (1, -1)]
    values += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "s double").select("s", order_code(F.col("s")).alias("c")).collect()
    assert all(r.c == _code(r.s) for r in got) and len(got) == len(values)


def within(seconds, run):
    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError()))
    signal.alarm(seconds)
    try:
        return run()
    finally:
        signal.alarm(0)


@pytest.mark.parametrize("base", [2**60, -(2**60) - 9, 2**63 - 10, -(2**63), 2**40, 0])
def test_tied_scores_with_neighbouring_large_identifiers(spark, base):
    rows = [("g", 0.5, base + i) for i in range(10)] + [("h", 0.5, base + 7 * i % 10) for i in range(10)] + [("h", 0.5, 3)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    for n in (1, 5):
        assert within(100, lambda n=n: rows_of(top_n(df, "g", "s", "i", n))) == brute(rows, n)


def test_identifiers_far_apart(spark):
    rnd = random.Random(2)
    rows = [("g", 0.5, rnd.choice([1, -1]) * 2 ** rnd.randrange(63) + rnd.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    assert within(100, lambda: rows_of(top_n(df, "g", "s", "i", 30))) == brute(rows, 30)


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_extreme_scores(spark, n):
    inf = float("inf")
    scores = [inf, 1e301, 0.5, -inf, 1e308, -1e308, 5e-324, -5e-324, 0.0, -0.0, 1e-300, inf, 1.7976931348623157e308]
    rows = [("g", s, i) for i, s in enumerate(scores)] + [("h", s, 0) for s in (inf, -inf)] + [("k", -inf, i) for i in range(5)] + [("l", 1.0, 1)]
    rows += [("m", 10.0**e, 1000 + e) for e in range(-320, 308, 3)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    assert within(100, lambda: rows_of(top_n(df, "g", "s", "i", n))) == brute(rows, n)


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 200)
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b"]), round(rnd.random(), 2), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    assert rows_of(top_n(df, "g", "s", "i", 300)) == brute(rows, 300)


def test_text_identifiers_extra_columns_and_empty(spark):
    rows = [("g", 0.5, "b"), ("g", 0.5, "a"), ("g", 0.1, "c")]
    df = spark.createDataFrame(
        rows, "g string, s double, i string",
    ).select("*", F.lit(1).alias("b")).select("*", F.lit(1).alias("need")).select("*", F.lit(1).alias("k")).select("*", F.lit(9).alias("G"))
    assert rows_of(top_n(df, "g", "s", "i", 2)) == [("g", "a", 0.5, 1), ("g", "b", 0.5, 2)]
    empty = top_n(df.limit(0), "g", "s", "i", 2)
    assert empty.isEmpty() and empty.columns == ["g", "i", "s", "rank"]
    with pytest.raises(ValueError):
        top_n(df, "g", "s", "i", 0)
