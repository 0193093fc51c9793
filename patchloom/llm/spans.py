"""Long exact spans shared between records, by level-wise doubling.

Windows of a quarter of the wanted length (``levels`` halvings) are compared
first; only those that occur in two records are extended to windows of twice
the length, and those again, until the wanted length is reached.  At each level but the last the
windows are a content-defined choice of all windows (see :mod:`.rolling`) that
misses no span of the wanted length: of the windows of length ``l`` inside any
stretch of ``min_length`` characters the one with the smallest hash is taken.
At the last level every window of ``min_length`` counts.  It belongs to the
half-length window chosen inside it, so the windows of one such anchor form a
short run of neighbours, and records whose runs read alike form a class.  Classes of
one anchor are compared in blocks of windows, again by class, and only one record of
each class of blocks that differ lists its windows one by one: an edit in a copy costs
a few rows and not all windows around it.

That decides the pairs.  For the report the doubling goes on past the wanted length.  What
was compared last (whole runs, blocks, single windows) are units: a shared window lies in a
unit that reads alike in all records that hold it, so a longer shared stretch is a sequence of
neighbouring units.  Sequences that always occur together become one unit; then sequences of
1, 2, 4, ... units that stand in two records are extended to twice their number until none
survives, and the way back down gives the longest sequence that starts at each unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import pick
from ..materialize import cut, drop
from ..skew import hot_buckets, join_one, repeat_one, split_many
from .rolling import CHUNK, Hasher, pieces, smallest

#: Records with survivors are found again through a table of at most so many hash buckets, which is broadcast.
BUCKETS = 1 << 16


def _anchors(codes: np.ndarray, need: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window of ``need``: the chosen window of ``width`` in it; and the hashes of all such windows."""
    hashes = Hasher(codes).all(width)
    return smallest(hashes, need - width + 1), hashes


def _starts(place: np.ndarray, texts: list[str], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Every start of a window of ``need`` inside a piece, and its piece."""
    count = np.array([len(t) - need + 1 for t in texts], np.int64)
    piece = np.repeat(np.arange(len(texts)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.arange(count.sum()) - first[piece] + place[piece], piece


def _first_level(need: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for codes, place, owner, at, held in pieces(((i, t.as_py()) for i, t in enumerate(texts)), need):
                chosen, hashes = _anchors(codes, need, width)
                start, _ = _starts(place, held, need)
                mark = np.zeros(len(codes), bool)
                mark[chosen[start]] = True
                pos = np.flatnonzero(mark)
                piece = np.searchsorted(place, pos, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner[piece])), pa.array((pos - place[piece] + at[piece])), pa.array(hashes[pos].view(np.int64)),
                    ], ["id", "pos", "h"]
                )

    return run


def _next_level(need: int, width: int):
    """Windows of ``width`` chosen inside those windows of ``need`` that hold a surviving window of ``width // 2``."""
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, survivors = batch.column(0), batch.column(1), batch.column(2)
            for codes, place, owner, at, held in pieces(((i, t.as_py()) for i, t in enumerate(texts)), need):
                chosen, hashes = _anchors(codes, need, width)
                start, piece = _starts(place, held, need)
                near = np.zeros(len(codes) + 1, np.int64)
                for k, i in enumerate(owner):
                    p = np.asarray(survivors[i].as_py(), np.int64) - at[k]
                    p = p[(p >= 0) & (p + half <= len(held[k]))]
                    np.add.at(near, place[k] + np.maximum(p - (need - half), 0), 1)
                    np.add.at(near, place[k] + p + 1, -1)
                start = start[np.cumsum(near)[start] > 0]
                mark = np.zeros(len(codes), bool)
                mark[chosen[start]] = True
                pos = np.flatnonzero(mark)
                piece = np.searchsorted(place, pos, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner[piece])), pa.array((pos - place[piece] + at[piece])), pa.array(hashes[pos].view(np.int64)),
                    ], ["id", "pos", "h"]
                )

    return run


def _runs(need: int, width: int):
    """For each surviving anchor the run of windows of ``need`` that belong to it, with the digest of the text the run covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, survivors, names = (batch.column(i) for i in range(4))
            for codes, place, owner, at, held in pieces(((i, t.as_py()) for i, t in enumerate(texts)), need):
                chosen, hashes = _anchors(codes, need, width)
                start, piece = _starts(place, held, need)
                alive = np.zeros(len(codes), bool)
                for k, i in enumerate(owner):
                    p = np.asarray(survivors[i].as_py(), np.int64) - at[k]
                    alive[place[k] + p[(p >= 0) & (p + width <= len(held[k]))]] = True
                anchor = chosen[start]
                keep = alive[anchor]
                start, piece, anchor = start[keep], piece[keep], anchor[keep]
                if not len(start):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
                last = np.concatenate([new[1:], [len(start)]]) - 1
                p, lo, hi, pos = piece[new], start[new], start[last], anchor[new]
                digest = [_digest(held[k][a - place[k] : b - place[k] + need]) for k, a, b in zip(p, lo, hi, strict=True)]
                shift = at[p] - place[p]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner[p])), pa.array(pos + shift), pa.array(hashes[pos].view(np.int64)), pa.array(pos - lo),
                        pa.array(pos - hi), pa.array(digest, pa.binary()), names.take(pa.array(owner[p])),
                    ],
                    ["id", "pos", "h", "left", "right", "digest", "t"],
                )

    return run


def _blocks(need: int, size: int):
    """The windows of the listed runs in blocks of ``size`` distances from the anchor.

    ``whole`` is the digest of all text the block's windows cover; ``core`` that of the text
    which every window at these distances covers, wherever the run ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                for r in runs.as_py():
                    p = r["pos"]
                    for k in range(r["right"] // size, r["left"] // size + 1):
                        near, far = max(r["right"], k * size), min(r["left"], k * size + size - 1)
                        core = text[p - k * size : p - k * size - size + 1 + need]
                        rows.append((r["run"], k, near, far, _digest(core), _digest(text[p - far : p - near + need])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["run", "k", "near", "far", "core", "whole"],
            )

    return run


def _leaves(need: int):
    """Every window of the listed blocks, by its distance before the anchor, with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, distances, digests = [], [], []
            for text, blocks in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                for b in blocks.as_py():
                    for d in range(b["near"], b["far"] + 1):
                        names.append(b["block"])
                        distances.append(d)
                        digests.append(_digest(text[b["pos"] - d : b["pos"] - d + need]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(distances, pa.int64()), pa.array(digests, pa.binary())],
                ["block", "distance", "digest"],
            )

    return run


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose hash occurs in two records, as one array of places for each record; the rows' table is dropped."""
    twice = rows.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a < b")
    twice = cut(twice.select("h", "n"))
    # A window of very many records (a licence, a template) is met in parts.
    hot = hot_buckets(twice, "h", "n")
    on = split_many(rows, "h", F.col("id"), hot).join(repeat_one(twice.select("h"), "h", hot), ["h", "_part"], "left_semi")
    found = cut(on.groupBy("id").agg(F.collect_set("pos").alias("at")))
    drop(rows, twice)
    return found


def _again(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of the records in ``found``, joined to it.

    The table of buckets has at most BUCKETS rows, so it may be broadcast; it keeps
    most other texts out of the shuffle.
    """
    bucket = lambda: F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("bucket")
    some = found.select(bucket()).distinct()
    near = texts.withColumn("bucket", bucket()).join(F.broadcast(some), "bucket", "left_semi").drop("bucket")
    return near.join(found, "id")


class SharedSpans:
    """The stretches of ``text`` of at least ``min_length`` code points that stand in two records.

    ``runs``: a row for each run of windows and class of records that read it alike;
    ``members``: the records of each class, with the run's place; ``blocks``: the parts of
    runs whose neighbourhood differs from others', by class; ``windows``: the single
    windows of those blocks that still differ.
    Records are told apart by ``id``: rows with equal ids are one record, a stretch
    repeated inside one record alone is not shared, and rows whose id is null name
    no record and are left out.  Null and short texts share nothing.
    """

    def __init__(self, df: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = 400, levels: int = 2):
        if levels < 1 or min_length >> levels < 4 or min_length > CHUNK // 2:
            raise ValueError("the first windows must have at least 4 characters, and min_length at most half a chunk")
        self.min_length = need = min_length
        self.all = pick(df, id=id, text=text).filter(F.col("id").isNotNull())
        texts = self.all.filter(F.col("text").isNotNull())
        place = T.StructType(
            [T.StructField("id", texts.schema["id"].dataType), T.StructField("pos", T.LongType()), T.StructField("h", T.LongType())]
        )
        widths = [(need >> levels) << k for k in range(levels)]
        found = _repeated(cut(texts.mapInArrow(_first_level(need, widths[0]), place)))
        for width in widths[1:]:
            found = _repeated(cut(_again(texts, found).select("id", "text", "at").mapInArrow(_next_level(need, width), place)))

        run = T.StructType(
            [
                *place.fields, T.StructField("left", T.LongType()), T.StructField("right", T.LongType()),
                T.StructField("digest", T.BinaryType()), T.StructField("t", T.LongType()),
            ]
        )
        # Texts of one record are told apart by their hash, so that places in them are not mixed up.
        last = _again(texts, found).select("id", "text", "at", F.xxhash64("text").alias("t"))
        rows = cut(last.mapInArrow(_runs(need, widths[-1]), run))
        same = ["h", "left", "right", "digest"]
        runs = rows.groupBy(*same).agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last"))
        self.runs = cut(
            runs.select(
                F.xxhash64(*same).alias("run"), "h", "left", "right", F.col("first.id").alias("rep"), F.col("first.pos").alias("pos"),
                (F.col("first.id") < F.col("last")).alias("shared"),
            )
        )
        self.members = rows.select(F.xxhash64(*same).alias("run"), "id", "t", "pos", "left", "right")

        # Runs of one anchor that differ are compared in blocks; blocks whose core is nobody else's hold no shared window.
        self.differ = cut(_two(self.runs, "h", "run"))
        listed = self.runs.join(self.differ, "h", "left_semi").groupBy(F.col("rep").alias("id")).agg(
            F.collect_list(F.struct("run", "pos", "left", "right")).alias("runs")
        )
        size = max(1, min(16, need // 8))
        parts = cut(
            _again(texts, listed).select("text", "runs").mapInArrow(
                _blocks(need, size), "run long, k long, near long, far long, core binary, whole binary",
            )
        )
        parts = parts.join(
            self.runs.select("run", "h", "rep", "pos", "shared"), "run",
        ).withColumn("core", F.xxhash64("h", "k", "core")).withColumn("block", F.xxhash64("h", "near", "far", "whole"))
        self.parts = cut(parts.select("run", "rep", "pos", "shared", "near", "far", "core", "block"))
        parts = cut(self.parts.join(_two(self.parts, "core", "run"), "core", "left_semi"))
        blocks = parts.groupBy("block").agg(
            F.min(F.struct("rep", "pos", "near", "far", "core")).alias("f"),
            (F.max("shared") | (F.min("rep") < F.max("rep"))).alias("held"),
        )
        self.blocks = cut(blocks.select("block", "f.*", "held"))
        self.of_run = parts.select("run", "block", "near", "far")

        self.mixed = cut(_two(self.blocks, "core", "block"))
        listed = self.blocks.join(self.mixed, "core", "left_semi").groupBy(F.col("rep").alias("id")).agg(
            F.collect_list(F.struct("block", "pos", "near", "far")).alias("blocks")
        )
        self.leaves = cut(
            _again(texts, listed).select("text", "blocks").mapInArrow(_leaves(need), "block long, distance long, digest binary")
        )
        self.windows = cut(self.leaves.join(_two(self.leaves, "digest", "block"), "digest", "left_semi"))

    def pairs(self) -> DataFrame:
        """Distinct ``(doc_a, doc_b)``, smaller first, of records that share a stretch: the output is all such pairs.

        Groups of the same records are expanded once, however many windows they share.
        """
        who = self.members.select("run", "id")
        groups = [who.join(self.runs.filter("shared").select("run"), "run", "left_semi").select(F.col("run").alias("key"), "id")]
        alike = self.of_run.select(F.col("block").alias("key"), "run").distinct()
        groups.append(_once(alike, "run").join(who, "run").select("key", "id"))
        windows = _once(self.windows.select(F.xxhash64("digest").alias("key"), "block").distinct(), "block")
        groups.append(windows.join(self.of_run.select("block", "run"), "block").join(who, "run").select("key", "id"))
        both = groups[0].unionByName(groups[1]).unionByName(groups[2])
        both = _once(cut(both.distinct()), "id")
        a, b = both.withColumnRenamed("id", "doc_a"), both.withColumnRenamed("id", "doc_b")
        return a.join(b, "key").filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()

    def units(self) -> DataFrame:
        """``id, t, first, last, key``: the first and last window start of every unit that two records hold.

        An anchor whose runs all read alike has its run as unit.  Else the units are blocks, or
        single windows where blocks of one core differ; which it is depends on the anchor or core
        alone, so it is the same in all records.
        """
        at = lambda far, near: ((F.col("pos") - F.col(far)).alias("first"), (F.col("pos") - F.col(near)).alias("last"))
        key = lambda kind, of: F.xxhash64(F.lit(kind), F.col(of)).alias("key")
        who = ["id", "t"]
        whole = self.runs.filter("shared").join(self.differ, "h", "left_anti").select("run")
        found = join_one(self.members, whole, "run", F.col("id")).select(*who, *at("left", "right"), key(0, "run"))
        cores = _two(self.parts, "core", "run").unionByName(self.parts.filter("shared").select("core")).distinct()
        parts = self.parts.select("run", "block", "core", "near", "far").join(cores, "core", "left_semi")
        mixed = self.mixed.withColumn("mixed", F.lit(True))
        parts = parts.join(mixed, "core", "left").select("run", "block", "near", "far", F.coalesce("mixed", F.lit(False)).alias("mixed"))
        own = self.members.select("run", *who, "pos").join(cut(parts), "run")
        found = found.unionByName(own.filter("not mixed").select(*who, *at("far", "near"), key(1, "block")))
        single = own.filter("mixed").select("block", *who, "pos").join(self.leaves, "block")
        found = cut(found.unionByName(single.select(*who, *at("distance", "distance"), key(2, "digest"))).distinct())
        return found.join(_two(found, "key", "id"), "key", "left_semi").select(*who, "first", "last", "key")

    def stretches(self) -> DataFrame:
        """``id, t, s, e``: the longest stretch from ``s`` on that another record holds as well.

        For each place where a unit begins; stretches that lie in an earlier one of the record are left out.
        """
        units = _joined(cut(self.units()))
        long = _longest(units).withColumn("e", F.col("e") + self.min_length)
        order = Window.partitionBy("id", "t").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        return long.withColumn("reach", F.max("e").over(order)).filter("reach is null or e > reach").drop("reach")

    def report(self) -> DataFrame:
        """One row for each record: ``id, n_chars, shared_chars, shared_share, n_spans, longest_span``.

        ``shared_chars`` counts the code points that lie in a stretch of at least
        ``min_length`` found in another record.  ``longest_span`` is the longest stretch
        that some one other record holds, ``n_spans`` the number of such stretches that lie in
        no longer one.  Of a record with several distinct texts all are counted.  An empty
        or null text has share 0.
        """
        spans = cut(self.stretches())
        order = Window.partitionBy("id", "t").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        # No stretch lies in another, so ends rise with starts, and what is new begins at the last end.
        new = F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(order), F.col("s")))
        spans = spans.withColumn("new", new).groupBy("id").agg(
            F.sum("new").alias("shared_chars"), F.count("*").alias("n_spans"), F.max(F.col("e") - F.col("s")).alias("longest_span"),
        )
        each = self.all.select("id", F.xxhash64("text").alias("t"), F.length("text").cast("long").alias("n")).distinct()
        size = each.groupBy("id").agg(F.sum("n").alias("n_chars"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        share = F.when(F.col("n_chars") > 0, F.coalesce(F.col("shared_chars"), F.lit(0)) / F.col("n_chars")).otherwise(F.lit(0.0))
        return size.join(spans, "id", "left").select(
            "id", "n_chars", zero("shared_chars"), share.alias("shared_share"), zero("n_spans"), zero("longest_span"),
        )


def _joined(units: DataFrame) -> DataFrame:
    """``id, t, i, s, e, key``: units that always follow each other as one; ``i`` counts them and skips one at each gap."""
    order = Window.partitionBy("id", "t").orderBy("first")
    n = units.groupBy("key").agg(F.count("*").alias("n"))
    u = units.join(n, "key")
    u = u.withColumn("before", F.when(F.lag("last").over(order) == F.col("first") - 1, F.struct(F.lag("key").over(order).alias("key"), F.lag("n").over(order).alias("n"))))
    u = cut(u)
    links = u.filter("before is not null").groupBy(F.col("before.key").alias("k"), F.col("key").alias("l")).agg(
        F.count("*").alias("c"), F.first("n").alias("nl"), F.first("before.n").alias("nk"),
    )
    firm = links.filter("c = nl and c = nk").select("k", "l").withColumn("firm", F.lit(True))
    u = u.join(firm, (F.col("before.key") == F.col("k")) & (F.col("key") == F.col("l")), "left")
    step = F.when(F.col("firm"), 0).when(F.col("before").isNotNull(), 1).otherwise(2)
    u = u.withColumn("i", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut(
        u.groupBy("id", "t", "i").agg(F.min("first").alias("s"), F.max("last").alias("e"), F.min_by("key", "first").alias("key"))
    )


def _longest(units: DataFrame) -> DataFrame:
    """``id, t, s, e`` for each unit: where the longest sequence of units that starts there and stands in two records ends.

    ``levels[k]`` holds the sequences of 2^k units that two records hold.  On the way down
    every unit keeps the sequence found so far, and takes the next 2^k units in if another
    record has the same.  Those that do so leave one of each kind behind, so that
    shorter matches still find them.
    """
    here = ["id", "t", "i"]
    levels = [units.select(*here, "key")]
    while True:
        k = levels[-1]
        after = k.select("id", "t", (F.col("i") - (1 << (len(levels) - 1))).alias("i"), F.col("key").alias("next"))
        twice = cut(k.join(after, here).select(*here, F.xxhash64("key", "next").alias("key")))
        twice = cut(twice.join(_two(twice, "key", "id"), "key", "left_semi").select(*here, "key"))
        if twice.isEmpty():
            break
        levels.append(twice)
    zero = F.lit(0).cast("long")
    rows = units.select(*here, zero.alias("n"), zero.alias("key"), F.col("id").alias("low"), F.col("id").alias("high"), F.lit(True).alias("own"))
    for k in range(len(levels) - 1, -1, -1):
        block = levels[k].select("id", "t", F.col("i").alias("at"), F.col("key").alias("block"))
        tried = rows.withColumn("at", F.col("i") + F.col("n")).join(block, ["id", "t", "at"], "left").drop("at")
        tried = cut(tried.withColumn("new", F.when(F.col("block").isNotNull(), F.xxhash64("key", "block"))).drop("block"))
        kinds = tried.filter("new is not null").groupBy("new").agg(
            F.min("low").alias("l"), F.max("high").alias("h"), F.max("own").alias("o"), F.min(F.struct(*here, "n", "key")).alias("one"),
        ).filter("l < h and o")
        kinds = cut(kinds)
        moved = tried.join(kinds.select("new", F.lit(True).alias("moves")), "new", "left")
        go = F.coalesce("moves", F.lit(False))
        moved = moved.select(
            *here, F.when(go, F.col("n") + (1 << k)).otherwise(F.col("n")).alias("n"), F.when(go, F.col("new")).otherwise(F.col("key")).alias("key"),
            "low", "high", "own",
        )
        left = kinds.select(*[f"one.{c}" for c in (*here, "n", "key")], F.col("l").alias("low"), F.col("h").alias("high"), F.lit(False).alias("own"))
        rows = cut(moved.unionByName(left)) if k else moved
    end = units.select("id", "t", F.col("i").alias("last"), "e")
    found = rows.filter("own and n > 0").withColumn("last", F.col("i") + F.col("n") - 1).select(*here, "last")
    return found.join(units.select(*here, "s"), here).join(end, ["id", "t", "last"]).select("id", "t", "s", "e")


def _two(rows: DataFrame, key: str, of: str) -> DataFrame:
    """The keys under which there are two different values of ``of``."""
    return rows.groupBy(key).agg(F.min(of).alias("_a"), F.max(of).alias("_b")).filter("_a < _b").select(key)


def _once(groups: DataFrame, of: str) -> DataFrame:
    """Of the groups (``key`` and distinct ``of``) with the same members one each; groups of one member none."""
    sets = groups.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(of)).alias("x"), F.bit_xor(F.xxhash64(of, F.lit(1))).alias("y"),
    )
    kept = sets.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return groups.join(kept, "key", "left_semi")
