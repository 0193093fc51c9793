"""Evaluation texts in a corpus, by a prefix-filtered set join on word shingles.

Both sides are reduced to lower-case words (:func:`plain`).  A document holds an
item if runs of ``run`` or more words that stand there cover ``share`` of the
item's words.  A run of ``run`` words is one shingle and covers ``run`` words, so
a document that holds ``need`` words has the shingles of at least
``ceil(need / run)`` places of the item; a shingle that the item repeats has
several places.  The most frequent shingles, as long as they have fewer places
together, are not enough; the rest is the item's prefix.  Only documents that
hold a shingle of the prefix are candidates; they must then have the shingles of
enough places and cover enough of the item's words, counted exactly over the item.
The length of a document says nothing: its words may serve many places.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import pick
from ..materialize import cut
from ..skew import hot_buckets, repeat_one, split_many
from .rolling import CHUNK, Hasher

#: Most bits of the filter that keeps other shingles out of the shuffle; it is broadcast, so this (64 MB) bounds its size.
#: With more shingles than it can tell apart it lets more rows through; the join that follows is exact.
FILTER_BITS = 1 << 29

# Letters that no decomposition takes apart, and dashes.
_LETTERS = str.maketrans(
    {
        "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ſ": "s", "\u00ad": None,
        "\u200b": None, "\u200c": None, "\u200d": None, "\u2060": None, "\ufeff": None, "\u2010": "-", "\u2011": "-",
    }
)

_ACCENT = re.compile(rb"\\+(?:[`'^\"~=.]\s*|[uvHtcdbrk](?=\{))\{?\\?([A-Za-z])\}?")
_POINTER = re.compile(rb"\\+(?:cite[a-z]*|[a-z]*ref|label)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}")
_COMMAND = re.compile(rb"\\+[A-Za-z@]+\*?")
_SOFT = re.compile(rb"\\+-")
_HYPHEN = re.compile(rb"(?<=[A-Za-z])-(?:[ \t]*\r?\n[ \t>%]*)?(?=[A-Za-z])")
_SPACE, _KEEP = 32, np.zeros(256, bool)
_TABLE = bytearray(b" " * 256)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _TABLE[_c] = ord(chr(_c).lower())
        _KEEP[_TABLE[_c]] = True


def plain(text: str) -> bytes:
    """The text's words, lower-case and ASCII, each followed by one blank.

    Set aside are markup (commands, references, labels), comment signs, case,
    punctuation, spacing, line ends, hyphens inside words and at line ends,
    accents and ligatures.  Letters outside Latin script are kept as their code
    points in hexadecimal, each a word.
    """
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).translate(_LETTERS)
        if not text.isascii():
            text = "".join(c if c.isascii() else f" {ord(c):x} " if c.isalnum() else " " for c in text)
    raw = text.encode("ascii")
    if b"\\" in raw:
        raw = _SOFT.sub(b"", raw)
        raw = _ACCENT.sub(rb"\1", raw)
        raw = _POINTER.sub(b" ", raw)
        raw = _COMMAND.sub(b" ", raw)
    raw = np.frombuffer(_HYPHEN.sub(b"", raw).translate(bytes(_TABLE)) + b" ", np.uint8)
    letter = _KEEP[raw]
    letter[1:] |= letter[:-1].copy()
    return raw[letter].tobytes()


def _shingles(codes: np.ndarray, texts: list[bytes], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, word position, start and end (in ``codes``, the texts end to end) of every shingle of ``run`` words."""
    ends = np.flatnonzero(codes == _SPACE)
    if len(ends) < run:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    starts = np.concatenate([[0], ends[:-1] + 1])
    owner = np.repeat(np.arange(len(texts)), [t.count(b" ") for t in texts])
    first = np.searchsorted(owner, np.arange(len(texts)))
    hashes = Hasher(codes).some(starts[: len(starts) - run + 1], ends[run - 1 :])
    inside = np.flatnonzero(owner[: len(owner) - run + 1] == owner[run - 1 :])
    return hashes[inside], owner[inside], inside - first[owner[inside]], starts[inside], ends[inside + run - 1]


def _chunks(texts: pa.Array, run: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts as words, in chunks; the words of a very long text lie in several, overlapping by ``run - 1``."""
    owners, bases, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        words = plain(t.as_py() or "")
        base = 0
        while words:
            part = words
            if len(part) > CHUNK // 2:
                at = words.find(b" ", CHUNK // 2) + 1
                part = words[:at]
                lead = part.rstrip(b" ").rsplit(b" ", run - 1)[1:] if at < len(words) else []
                words = b" ".join([*lead, words[at:]]) if at < len(words) else b""
            else:
                words, lead = b"", []
            if held and size + len(part) > CHUNK:
                yield owners, bases, held
                owners, bases, held, size = [], [], [], 0
            owners.append(i)
            bases.append(base)
            held.append(part)
            size += len(part)
            base += part.count(b" ") - len(lead)
    if held:
        yield owners, bases, held


def _hits(run: int, bits: np.ndarray | None):
    """Rows ``id, n_words, at, h, d``: the shingles of each text that pass the filter, with the digest of their words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for owners, bases, held in _chunks(batch.column(1), run):
                raw = b"".join(held)
                h, piece, at, start, end = _shingles(np.frombuffer(raw, np.uint8), held, run)
                if bits is not None:
                    slot = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
                    keep = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    h, piece, at, start, end = (x[keep] for x in (h, piece, at, start, end))
                digest = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                words = np.array([p.count(b" ") for p in held], np.int64) + np.array(bases)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.array(owners, np.int64)[piece])), pa.array(words[piece]),
                        pa.array(at + np.array(bases, np.int64)[piece]), pa.array(h.view(np.int64)), pa.array(digest, pa.binary()),
                    ],
                    ["id", "n_words", "at", "h", "d"],
                )

    return scan


def _filter_bits(items: DataFrame) -> np.ndarray:
    """The filter of the shingles in ``items``, some 16 bits for each, in rows of 4 KB for each used bucket of bits."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(18, (16 * items.count()).bit_length()))
    low = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    rows = items.select(low.alias("bit")).distinct().groupBy(F.bitmap_bucket_number("bit").alias("k"))
    bits = np.zeros(size // 8, np.uint8)
    for k, b in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("b")).toLocalIterator():
        # Bucket k holds the values from (k - 1) * 32768 + 1 on.
        bits[(k - 1) * 4096 : (k - 1) * 4096 + 4096] = np.frombuffer(b, np.uint8)
    return bits


def _covered(run: int) -> Column:
    """Words of the item that its found shingles cover: of each ``run``, or as many as lie before the next."""
    at = F.array_sort(F.collect_set("item_at"))
    gaps = F.transform(at, lambda x, i: F.when(i + 1 < F.size(at), F.least(F.lit(run), F.get(at, i + 1) - x)).otherwise(F.lit(run)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def find_leaks(
    corpus: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 5, share: float = 0.5
) -> DataFrame:
    """``doc_id, item_id, n_words, words_found, share``: the documents that hold ``share`` of an item.

    A row for each pair, named as ``id`` and ``item_id``.  Items of fewer than ``run``
    words cannot be found.  Rows with a null id or text hold nothing; rows with equal
    ids count as one document whose texts are separate, and of repeated items each
    text counts.  Ties play no part.
    """
    if run < 1 or not 0 < share <= 1:
        raise ValueError("run must be at least 1 and share lie between 0 and 1")
    texts = pick(corpus, id=id, text=text).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    wanted = pick(items, item=item_id, text=item_text).filter(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    kind, item_kind = texts.schema["id"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    rows = f"id {item_kind}, n_words long, at long, h long, d binary"
    known = cut(
        wanted.mapInArrow(_hits(run, None), rows).select(
            F.col("id").alias("item"), F.col("n_words").alias("m"), F.col("at").alias("item_at"), "h", "d",
        )
    )
    # An item spelled in several texts keeps the longest text's length.
    known = known.withColumn("m", F.max("m").over(Window.partitionBy("item")))
    bits = _filter_bits(known)
    hits = cut(texts.mapInArrow(_hits(run, bits), rows.replace(item_kind, kind, 1)))

    # Rarity over the whole corpus: documents that hold the shingle.
    held = hits.groupBy("id").agg(F.collect_set("h").alias("hs")).select("id", F.size("hs").alias("size"), F.explode("hs").alias("h"))
    rarity = cut(held.groupBy("h").agg(F.count("*").alias("df")))
    of_item = known.groupBy("item", "m", "h").agg(F.count_distinct("item_at").alias("places")).join(rarity, "h", "left").fillna(0, ["df"])
    need = F.ceil(F.col("m") * F.lit(float(share)) - F.lit(1e-9))
    least = F.ceil(need / F.lit(float(run)))
    # Places of the shingle and of all more frequent ones; and of it and all that have more places.
    order = Window.partitionBy("item").orderBy(F.desc("df"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = of_item.withColumn("k", F.sum("places").over(order)).withColumn("of_prefix", F.col("k") >= least)
    full = Window.partitionBy("item").orderBy(F.desc("places"), "h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("filled", F.sum("places").over(full))
    whole = Window.partitionBy("item")
    ranked = ranked.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("of_prefix"), F.col("places"))).over(whole), F.lit(0)))
    ranked = ranked.withColumn("fewest", F.sum(F.when(F.col("filled") - F.col("places") < least, 1).otherwise(0)).over(whole))
    prefix = cut(ranked.filter("of_prefix and df > 0").select("item", "h", "places", "fewest", (least - F.col("rest")).alias("wanted")))
    # A shingle that very many documents hold meets its items in parts.
    hot = hot_buckets(rarity, "h", "df")
    pairs = split_many(held, "h", F.col("id"), hot).join(repeat_one(prefix, "h", hot), ["h", "_part"]).filter(F.col("size") >= F.col("fewest"))
    pairs = pairs.groupBy("id", "item").agg(F.sum("places").alias("n"), F.max("wanted").alias("wanted")).filter("n >= wanted").select("id", "item")
    found = known.join(pairs, "item").join(hits.select("id", "h", "d").distinct(), ["id", "h", "d"])
    found = found.groupBy("id", "item", "m").agg(F.count_distinct("item_at").alias("k"), _covered(run).alias("words"))
    found = found.filter(F.col("k") >= least).filter(F.col("words") >= need)
    return found.select(
        F.col("id").alias(id), F.col("item").alias(item_id), F.col("m").alias("n_words"), F.col("words").alias("words_found"),
        (F.col("words") / F.col("m")).alias("share"),
    )
