import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom import skew
from patchloom.llm import rolling
from patchloom.llm.spans import SharedSpans


def brute(rows, need):
    texts = defaultdict(list)
    for d, t in rows:
        if d is not None and t is not None:
            texts[d].append(t)
    win = defaultdict(set)
    for d, ts in texts.items():
        for t in ts:
            for q in range(len(t) - need + 1):
                win[t[q : q + need]].add(d)
    pairs = {(a, b) for g in win.values() for a in g for b in g if a < b}
    shared = {}
    return pairs, _marked(texts, win, need, shared)


def longest(rows, need):
    """For each record: how many maximal stretches it has, and the longest, by pairs of places."""
    texts = {(d, t) for d, t in rows if d is not None and t is not None}
    places = defaultdict(list)
    for d, t in texts:
        for q in range(len(t) - need + 1):
            places[t[q : q + need]].append((d, t, q))
    out = {}
    for d, t in texts:
        ends, found = 0, []
        for q in range(len(t) - need + 1):
            best = 0
            for d2, t2, q2 in places[t[q : q + need]]:
                if d2 != d:
                    n = need
                    while q + n < len(t) and q2 + n < len(t2) and t[q + n] == t2[q2 + n]:
                        n += 1
                    best = max(best, n)
            if best and q + best > ends:
                ends = q + best
                found.append(best)
        n, m = out.get(d, (0, 0))
        out[d] = (n + len(found), max([m, *found]))
    return out


def _marked(texts, win, need, shared):
    for d, ts in texts.items():
        t = ts[0]
        mark = np.zeros(len(t), bool)
        for q in range(len(t) - need + 1):
            if len(win[t[q : q + need]]) > 1:
                mark[q : q + need] = True
        shared[d] = int(mark.sum())
    return shared


def case(seed, need):
    rnd = random.Random(seed)
    chars = "abcdefgh \né\U0001f600"
    word = lambda n: "".join(rnd.choice(chars) for _ in range(n))
    banks = [word(rnd.choice([need - 1, need, need + 1, 2 * need, 5 * need])) for _ in range(12)]
    plate = word(need - 2)
    rows = []
    for d in range(60):
        parts = [word(rnd.randrange(0, 3 * need)) for _ in range(3)]
        for _ in range(rnd.randrange(3)):
            b = rnd.choice(banks)
            a = rnd.randrange(len(b))
            parts.insert(rnd.randrange(len(parts)), b if rnd.random() < 0.6 else b[a:])
        rows.append((d, (plate if d % 3 == 0 else "") + "".join(parts)))
    copy = rows[7][1]
    rows += [(100 + i, copy) for i in range(8)] + [(110, copy[: len(copy) // 2] + "X" + copy[len(copy) // 2 :])]
    own = [word(3 * need) for _ in range(4)]
    for i, b in enumerate(own):
        # A stretch twice in one record, of which another record holds a part.
        rows += [(300 + 2 * i, word(9) + b + word(7) + b + word(5)), (301 + 2 * i, word(i * 3) + b[i * 5 : i * 5 + need + 7 * i] + word(4))]
    rows += [(200, None), (201, ""), (202, "short"), (None, copy), (203, "z" * (3 * need)), (204, "z" * need), (205, word(2 * need) * 2)]
    return rows


@pytest.mark.parametrize(("seed", "need", "levels"), [(0, 40, 2), (1, 40, 3), (2, 101, 2), (3, 64, 1)])
def test_against_brute_force(spark, seed, need, levels):
    rows = case(seed, need)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("Text")).select("*", F.lit(0).alias("h"))
    s = SharedSpans(df, min_length=need, levels=levels)
    pairs, shared = brute(rows, need)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    rep = {r.id: r for r in s.report().collect()}
    assert {d: r.shared_chars for d, r in rep.items()} == shared | {200: 0}
    assert {d: (r.n_spans, r.longest_span) for d, r in rep.items()} == longest(rows, need) | {200: (0, 0)}
    assert rep[200].n_chars is None and rep[201].shared_share == 0 and rep[100].shared_share == 1


def test_repeated_rows_and_text_ids(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([("a", t), ("a", t), ("b", "x" * 50 + t[:100]), ("c", t[200:] + t[200:])], "doc_id string, text string")
    s = SharedSpans(df, min_length=60)
    assert {tuple(r) for r in s.pairs().collect()} == {("a", "b"), ("a", "c")}
    got = {r.id: (r.shared_chars, r.n_spans, r.longest_span) for r in s.report().collect()}
    assert got == {"a": (200, 2, 100), "b": (100, 1, 100), "c": (200, 2, 100)}


def test_neighbouring_stretches_of_different_partners(spark):
    rnd = random.Random(9)
    x, y = ("".join(rnd.choice("abcdefghij ") for _ in range(400)) for _ in range(2))
    rows = [(1, x + y), (2, "2" + x + "3"), (3, "4" + y + "5"), (4, y[50:] + x), (5, None)]
    got = {r.id: (r.shared_chars, r.n_spans, r.longest_span) for r in SharedSpans(spark.createDataFrame(rows, "doc_id long, text string")).report().collect()}
    assert got == {1: (800, 2, 400), 2: (400, 1, 400), 3: (400, 1, 400), 4: (400, 1, 400), 5: (0, 0, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_edited_copies(spark, seed):
    """Stretches of many units, whose partners end at different places."""
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(1500))
    rows = []
    for d in range(25):
        t = base[rnd.randrange(600) : 1500 - rnd.randrange(600)]
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(t))
            t = t[:k] + rnd.choice(["#", "", "##"]) + t[k + rnd.randrange(3) :]
        rows.append((d, t))
    rows += [(50, base), (51, base), (52, "z" * 300), (53, "z" * 200), (54, base + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = SharedSpans(df, min_length=40)
    pairs, shared = brute(rows, 40)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    rep = {r.id: r for r in s.report().collect()}
    assert {d: r.shared_chars for d, r in rep.items()} == shared
    assert {d: (r.n_spans, r.longest_span) for d, r in rep.items()} == longest(rows, 40)


def test_very_long_text(spark, monkeypatch):
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefghij") for _ in range(1_300_000))
    at = rolling.CHUNK // 2 - 150
    df = spark.createDataFrame(
        [(1, base), (2, "q" * 500 + base[at : at + 400] + "r" * 500), (3, base[-450:] + "s"), (4, base[at : at + 399])],
        "doc_id long, text string",
    )
    s = SharedSpans(df)
    assert {tuple(r) for r in s.pairs().collect()} == {(1, 2), (1, 3)}
    assert {r.id: r.shared_chars for r in s.report().collect()} == {1: 850, 2: 400, 3: 450, 4: 0}


def test_a_template_in_all_records_is_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 20)
    rows = case(11, 40) + [(1000 + i, "the template that all of these records begin with, word for word " + str(i) * 50) for i in range(60)]
    s = SharedSpans(spark.createDataFrame(rows, "doc_id long, text string"), min_length=40)
    pairs, shared = brute(rows, 40)
    assert {tuple(r) for r in s.pairs().collect()} == pairs
    rep = {r.id: r for r in s.report().collect()}
    assert {d: r.shared_chars for d, r in rep.items()} == shared | {200: 0}
    assert {d: (r.n_spans, r.longest_span) for d, r in rep.items()} == longest(rows, 40) | {200: (0, 0)}


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for d in (df, df.limit(0)):
        s = SharedSpans(d)
        assert s.pairs().isEmpty() and all(r.shared_chars == 0 for r in s.report().collect())
    with pytest.raises(ValueError):
        SharedSpans(df, min_length=3)


def test_rolling():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 5, 300).astype(np.uint32)
    h = rolling.Hasher(a)
    for w in (1, 7, 50):
        x = h.all(w)
        by = defaultdict(set)
        for i in range(len(x)):
            by[x[i]].add(a[i : i + w].tobytes())
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({a[i : i + w].tobytes() for i in range(len(x))})
        assert (h.some(np.arange(10), np.arange(10) + w) == x[:10]).all()
    v = rng.integers(0, 1000, 200).astype(np.uint64)
    for w in (1, 2, 3, 17, 64, 200):
        assert (rolling.sliding_min(v, w) == [v[i : i + w].min() for i in range(200 - w + 1)]).all()
