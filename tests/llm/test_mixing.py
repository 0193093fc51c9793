import os

import pytest
from pyspark.sql import functions as F

from patchloom.llm.mixing import VOCABULARY, Mix, source_key, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def docs(spark):
    rows = [
        (
            i, f"word number {i} and some more text " * (1 + i % 4),
            ["big", " BIG ", "b-i g"][i % 3] if False else ["big_one", " Big One ", "BIG-ONE"][i % 3],
        ) for i in range(300)
    ]
    rows += [(1000 + i, "tiny text here", "small") for i in range(5)]
    rows += [
        (2000, None, "big_one"), (2001, "", "big_one"), (2002, "unnamed", "other"), (2003, "nobody", None), (None, "no id", "small"),
        (1000, "tiny text here", "small"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string",
    ).select("*", F.lit("x").alias("Text")).select("*", F.lit(1).alias("n"))


def targets(spark):
    return spark.createDataFrame(
        [("big_one", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_weight double, max_repeats int",
    )


def test_source_key(spark):
    df = spark.createDataFrame([("Big_One",), (" big one\t",), ("BIG-ONE",), ("big__one",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(source_key(F.col("x"))).collect()] == ["big_one"] * 4 + [None, None]


def test_mix(spark):
    m = Mix(docs(spark), targets(spark))
    enc = tokenizer(VOCABULARY)
    size = {r.id: r.n for r in m.sizes.collect()}
    for r in docs(spark).filter("doc_id < 2000").collect():
        assert size[r.doc_id] == len(enc.encode_ordinary(r.text))
    assert size[2000] == size[2001] == 0 and 2002 not in size and 2003 not in size and None not in size
    rep = {r.source: r for r in m.report().collect()}
    total = sum(r.tokens for r in rep.values())
    assert rep["small"].docs == 6 and rep["absent"].tokens == 0
    assert {k: r.cannot_fill for k, r in rep.items()} == {"big_one": False, "small": True, "absent": True}
    longest = max(size.values())
    assert 0 <= 0.7 * total - rep["big_one"].tokens_used < longest + 1
    assert rep["small"].tokens_used == rep["small"].tokens * 3
    assert rep["small"].shortfall == pytest.approx(0.2 * total - rep["small"].tokens * 3)
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    rows = m.mix.collect()
    assert max(r.copies for r in rows if r.source == "big_one") == 1 and {r.copies for r in rows if r.source == "small"} == {3}
    again = Mix(docs(spark).repartition(7), targets(spark)).mix.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_repeats_fill_a_small_source(spark):
    t = spark.createDataFrame([("small", 1.0, 4), ("small", 0.5, 9)], "source string, target_weight double, max_repeats int")
    m = Mix(docs(spark), t, total=45)
    r = m.report().first()
    assert r.max_repeats == 4 and not r.cannot_fill and r.tokens_used <= 45 < r.tokens_used + 4
    assert {x.copies for x in m.mix.collect()} <= {2, 3, 4}


def test_nothing(spark):
    m = Mix(docs(spark).limit(0), targets(spark))
    assert m.mix.isEmpty() and all(r.tokens_used == 0 for r in m.report().collect())
    assert Mix(docs(spark), targets(spark).limit(0)).report().isEmpty()
