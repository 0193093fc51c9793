import random

import pytest
from pyspark.sql import functions as F

from patchloom import skew
from patchloom.llm import leakage
from patchloom.llm.leakage import find_leaks, plain


@pytest.mark.parametrize(
    ("text", "words"),
    [
        (r"The \emph{Quick}  brown-fox, \textbf{jumps}~over", "the quick brownfox jumps over"),
        ("a mea-\n% sured value", "a measured value"),
        ("a mea-\r\n   sured value", "a measured value"),
        (r"the cascade~\citep{abc1969,def2000} shows \cref{lem:x} it\label{eq:a}", "the cascade shows it"),
        (r"na\"{\i}ve caf\'e \c{c}a", "naive cafe ca"),
        ("naïve caﬁn ＡＢ “yes”", "naive cafin ab yes"),
        (r"\\documentclass{x} \\emph{y}", "x y"),
        (r"hy\-phen", "hyphen"),
        ("% commented text", "commented text"),
        ("soft­hyphen zero​width", "softhyphen zerowidth"),
        ("αβ", "3b1 3b2"),
        ("", ""),
    ],
)
def test_plain(text, words):
    assert plain(text).decode().split() == words.split()


def brute(docs, items, run=5, share=0.5):
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        w = plain(t).decode().split()
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for j, u in items:
            if j is None or u is None:
                continue
            v = plain(u).decode().split()
            hit = set()
            for i in range(len(v) - run + 1):
                if tuple(v[i : i + run]) in have:
                    hit.update(range(i, i + run))
            if v and len(hit) >= len(v) * share:
                out.add((d, j))
    return out


def case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    start = [rnd.choice(vocab) for _ in range(8)]
    items = [(j, " ".join((start if j % 3 == 0 else []) + [rnd.choice(vocab) for _ in range(rnd.randrange(3, 50))])) for j in range(40)]
    docs = []
    for d in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            v = rnd.choice(items)[1].split()
            a = rnd.randrange(len(v))
            b = rnd.randrange(a, len(v)) + 1
            at = rnd.randrange(len(w) + 1)
            part = v[a:b]
            if len(part) > 8 and rnd.random() < 0.5:
                part[len(part) // 2] = "changed"
            w[at:at] = part
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, items[5][1]), (902, items[5][1])]
    items += [(800, None), (801, ""), (802, "one two three"), (None, "x " * 20), (5, items[5][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "share", "run"), [(0, 0.5, 5), (1, 0.5, 5), (2, 0.3, 5), (3, 1.0, 3)])
def test_against_brute_force(spark, seed, share, run):
    docs, items = case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit("x").alias("TEXT")).select("*", F.lit(1).alias("h"))
    i = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("id"))
    got = find_leaks(d, i, run=run, share=share).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, run, share) and len(got) == len({(r.doc_id, r.item_id) for r in got})


@pytest.mark.parametrize(("share", "run"), [(0.5, 5), (1.0, 5), (0.3, 3)])
def test_items_that_repeat_their_words(spark, share, run):
    refrain = "one two three four five six seven "
    items = [
        (1, "x " * 60), (2, "0 1 " * 30), (3, refrain * 12), (4, "x " * 30 + " ".join(f"w{i}" for i in range(30))),
        (5, " ".join(f"v{i}" for i in range(20)) + " " + refrain * 3), (6, "a b c d e z b c d e f"),
    ]
    docs = [
        *((i, "before " + t + " after") for i, t in items), (10, "x x x x x"), (11, "x x x x"), (12, refrain), (13, refrain * 2), (14, "0 1 0 1 0 1"),
        (15, " ".join(f"w{i}" for i in range(14))), (16, " ".join(f"w{i}" for i in range(30))), (17, "a b c d e f"), (18, "0 0 0 0 0 0"),
    ]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, run, share)
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, i, run=run, share=share).collect()} == want and {(j, j) for j, _ in items} <= want


def test_an_item_spread_over_the_texts_of_one_document(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words[:12])), (1, "z " + " ".join(words[12:24]) + " z"), (2, " ".join(words[:12])), (3, " ".join(words[:20]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {(r.doc_id, r.words_found) for r in find_leaks(d, i).collect()} == {(1, 24), (3, 20)}


def test_equal_hashes_are_told_apart_by_their_words(spark, monkeypatch):
    """All shingles share one hash: the digests decide."""

    class Same(leakage.Hasher):
        def some(self, start, end):
            return super().some(start, end) & leakage.np.uint64(3)

    bare = leakage._hits
    monkeypatch.setattr(leakage, "Hasher", Same)
    rows = list(bare(5, None)(iter([leakage.pa.RecordBatch.from_arrays([leakage.pa.array([7]), leakage.pa.array(["a b c d e f g h i j k l"])], ["id", "text"])])))
    assert len(set(rows[0].column(3).to_pylist())) <= 4 and len(set(rows[0].column(4).to_pylist())) == 8


def test_frequent_shingles_meet_their_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 20)
    docs, items = case(6)
    docs += [(2000 + i, f"filler {i} " + items[0][1]) for i in range(100)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()} == brute(docs, items)


def test_very_long_text(spark, monkeypatch):
    docs, items = case(5)
    long = " ".join(f"filler{i % 977}" for i in range(400_000)) + " " + items[1][1] + " " + " ".join(f"end{i % 13}" for i in range(5000))
    d = spark.createDataFrame([(1, long), (2, items[1][1] + " " + long)], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()} == {(1, 1), (2, 1)}


def test_chunks_keep_every_shingle():
    import pyarrow as pa

    text = " ".join(f"x{i}" for i in range(300_000))
    rows = list(leakage._hits(5, None)(iter([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["id", "text"])])))
    at = sorted(x for b in rows for x in b.column(2).to_pylist())
    assert sorted(set(at)) == list(range(299_996))


def test_nothing(spark):
    docs, items = case(0)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert find_leaks(d.limit(0), i).isEmpty() and find_leaks(d, i.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        find_leaks(d, i, share=0.0)
