"""Mixes of sources by target weights, in tokens."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import pick
from ..materialize import cut
from ..ranking import grouped_prefix_sum

#: Where the vocabulary lies on the driver, which sends it to the executors; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level tokenizer of a vocabulary file, loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _counts(path: str):
    """Rows ``id, source, n``; ``path`` is the name of a file sent to the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(path)).encode_ordinary
        for batch in batches:
            n = [0 if t is None else len(encode(t)) for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "source", "n"])

    return run


def source_key(value: Column) -> Column:
    """A source's name with case, blanks and separators undone; null if none is left."""
    text = F.regexp_replace(F.regexp_replace(F.lower(value), r"[\s\p{Z}\p{Pd}_.]+", "_"), "^_+|_+$", "")
    return F.when(text != "", text)


class Mix:
    """Documents of several sources in given shares of the tokens.

    ``sizes``: the tokens of each document; ``mix``: the documents in the mix and how
    often each is used; ``report()``: the shares reached and what is lacking.

    The mix has as many tokens as all documents of the named sources, unless ``total``
    is given.  A source short of tokens is used up to ``max_repeats`` times; the last,
    partial pass takes documents in a hashed order up to the source's budget, so a
    source stays below its budget by less than one document.  Null texts have no
    tokens and, like those of null ids and of sources without a target, take no part.
    Rows with equal ids are separate documents.  Weights count as parts of their sum;
    null, NaN or negative weights and repeats count as 0.
    """

    def __init__(
        self, docs: DataFrame, targets: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
        weight: str = "target_weight", repeats: str = "max_repeats", total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 0,
    ):
        rows = pick(docs, id=id, source=source, text=text).filter(F.col("id").isNotNull()).withColumn("source", source_key(F.col("source")))
        kind = rows.schema["id"].dataType.simpleString()
        named = pick(
            targets, name=source, weight=weight, repeats=repeats,
        ).withColumn("source", source_key(F.col("name"))).filter("source is not null")
        # Of repeated names the one with the largest weight holds.
        named = named.groupBy("source").agg(
            F.max(
                F.struct(
                    F.nanvl(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"),
                    F.coalesce(F.col("repeats").cast("long"), F.lit(0)).alias("repeats"), "name",
                )
            ).alias("t")
        )
        named = named.select(
            "source", "t.name", F.greatest(F.col("t.weight"), F.lit(0.0)).alias("weight"),
            F.greatest(F.col("t.repeats"), F.lit(0)).alias("repeats"),
        )
        named = cut(named)
        wanted = rows.join(named.select("source"), "source", "left_semi").select("id", "source", "text")
        docs.sparkSession.sparkContext.addFile(vocabulary)
        self.sizes = cut(wanted.mapInArrow(_counts(os.path.basename(vocabulary)), f"id {kind}, source string, n long"))
        have = self.sizes.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
        sums = have.agg(F.sum("tokens")).first()[0] or 0
        self.total = sums if total is None else total
        scale = named.agg(F.sum("weight")).first()[0] or 1.0
        plan = named.join(have, "source", "left").fillna(0, ["tokens", "docs"]).withColumn(
            "weight", F.col("weight") / F.lit(scale) if abs(scale - 1) > 1e-9 else F.col("weight"),
        )
        plan = plan.withColumn("budget", F.col("weight") * F.lit(float(self.total)))
        plan = plan.withColumn("reach", F.col("tokens") * F.col("repeats")).withColumn(
            "goal", F.least(F.floor("budget"), F.col("reach")).cast("long"),
        )
        plan = plan.withColumn(
            "passes", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"),
        )
        self.plan = cut(plan.withColumn("rest", F.col("goal") - F.col("passes") * F.col("tokens")))
        keyed = cut(self.sizes.filter("n > 0").withColumn("h", F.xxhash64("id", F.lit(seed))))
        placed = grouped_prefix_sum(keyed, ["source"], ["h", "id", "n"], "n")
        used = placed.join(self.plan.select("source", "name", "passes", "rest"), "source")
        copies = (F.col("passes") + F.when(F.col("before") + F.col("n") <= F.col("rest"), 1).otherwise(0)).cast("long")
        self.mix = cut(
            used.select(
                F.col("id").alias(id), F.col("name").alias(source), F.col("n").alias("n_tokens"), copies.alias("copies"),
            ).filter("copies > 0")
        )
        self._source = source

    def report(self) -> DataFrame:
        """``source, target_weight, max_repeats, docs, tokens, budget, tokens_used, actual_share, shortfall, cannot_fill``.

        ``shortfall``: tokens that the source lacks even when repeated as often as allowed; it
        ``cannot_fill`` its budget if all it may give is in the mix and that is less.
        """
        used = self.mix.groupBy(F.col(self._source).alias("name")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"))
        full = self.mix.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 1
        short = F.when(F.col("tokens_used") == F.col("reach"), F.col("budget") - F.col("tokens_used")).otherwise(F.lit(0.0))
        return self.plan.join(used, "name", "left").fillna(0, ["tokens_used"]).select(
            F.col("name").alias(self._source), F.col("weight").alias("target_weight"), F.col("repeats").alias("max_repeats"), "docs", "tokens", "budget", "tokens_used",
            (F.col("tokens_used") / F.lit(full)).alias("actual_share"), F.greatest(short, F.lit(0.0)).alias("shortfall"), (
                short > 0
            ).alias("cannot_fill"),
        )
