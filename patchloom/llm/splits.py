"""Splits that keep records of a common entity together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import pick
from ..materialize import cut, drop
from ..ranking import grouped_prefix_sum
from ..skew import hot_buckets, join_one, repeat_one, split_many

#: Most profiles whose left-over components are placed one after the other.
GREEDY = 100_000


def components(edges: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """``entity, component``: the smallest entity each entity is connected to.

    Minimum labels pass between records and entities until nothing changes; a label's
    own label is followed in each round, so that chains shorten to half.  Records of a
    single entity link nothing.  A record of several links its smallest entity to each
    other one, so that records which name the same entities pass their labels once.
    Entities of many links, and labels of many entities, are joined in parts.  Null records and entities link nothing.
    """
    e = pick(edges, r=record, e=entity).filter("r is not null and e is not null")
    first = e.groupBy("r").agg(F.min("e").alias("a"), F.max("e").alias("z")).filter("a < z").select("r", "a")
    links = e.join(first, "r").filter("e > a").select("a", F.col("e").alias("b")).distinct()
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    hot = hot_buckets(links, "b")
    many = split_many(links, "b", F.col("a"), hot)
    label = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("e"), F.least("a", "m").alias("l")))
    while True:
        of_b = repeat_one(label.select(F.col("e").alias("b"), "l"), "b", hot)
        low = many.join(of_b, ["b", "_part"]).groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "e")
        new = cut(label.join(low, "e").select("e", "l", F.least("l", "m").alias("m")))
        hop = label.select(F.col("e").alias("m"), F.col("l").alias("ll"))
        step = cut(join_one(new, hop, "m", F.col("e")).select("e", F.least("m", "ll").alias("l"), (F.least("m", "ll") < F.col("l")).alias("changed")))
        if step.filter("changed").isEmpty():
            break
        drop(label, new)
        label = step.select("e", "l")
    rest = e.select("e").distinct().join(label, "e", "left")
    return rest.select(F.col("e").alias(entity), F.coalesce("l", "e").alias("component"))


def related(records: DataFrame, edges: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """``record, component``: null for a record that names nobody.  Distinct records; a null record is none."""
    all_ = pick(records, r=record).filter("r is not null").distinct()
    named = pick(edges, r=record, e=entity)
    own = cut(named.filter("r is not null and e is not null").groupBy("r").agg(F.min("e").alias("e")))
    own = join_one(own, components(named, "r", "e"), "e", F.col("r"))
    return all_.join(own.select("r", "component"), "r", "left").select(F.col("r").alias(record), "component")


def grouped_split(
    records: DataFrame, component: str, label: str, parts: dict[str, float], *, record: str = "record", seed: int = 0,
) -> DataFrame:
    """``record, component, split``: records of one component always share a split.

    Components with equal counts of every label form a profile.  Of each profile every
    split gets its share of the components, rounded down, in hashed order.  The fewer
    than ``len(parts)`` components of each profile that are left over are placed one
    after the other, largest first, where the squared deviations of the split's label
    counts (null is a label) and of its size grow least; all that was placed before counts.
    This takes one task, whose state is a number for each label and split.  If more than
    ``GREEDY`` profiles have such components, it takes the largest; all components of the
    others are placed before, in strata by commonest label, each laid end to end, largest
    first, then in hashed order, and cut at the shares by the middles of the components.
    A null component stands for a record of its own; rows with neither go together.
    """
    if not parts or any(p < 0 for p in parts.values()) or sum(parts.values()) <= 0:
        raise ValueError("parts must be shares of which one is positive")
    names = [n for n, p in parts.items() if p > 0]
    shares = [parts[n] / sum(parts.values()) for n in names]
    own = F.coalesce(F.concat(F.lit("c"), F.col("c").cast("string")), F.concat(F.lit("r"), F.col("r").cast("string")), F.lit(""))
    rows = pick(records, r=record, c=component, label=label)
    rows = cut(rows.select("r", "c", own.alias("k"), F.col("label").cast("string").alias("label")))
    votes = rows.groupBy("k", "label").agg(F.count("*").alias("n"))
    groups = votes.groupBy("k").agg(F.to_json(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("p"))
    groups = cut(groups.withColumn("h", F.xxhash64("k", F.lit(seed))))
    placed = cut(grouped_prefix_sum(groups, ["p"], ["h", "k"], F.lit(1), before="i", total="g").select("k", "p", "i", "g"))

    # Of g components, split j gets floors[j]; "rest" are left over.
    floors = F.array(*[F.floor(F.col("g") * F.lit(s) + F.lit(1e-9)).cast("long") for s in shares])
    profiles = placed.select("p", "g").distinct().withColumn("v", F.from_json("p", "array<struct<label:string,n:long>>"))
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    profiles = profiles.select("p", "g", "v", size.alias("n"), floors.alias("floors"))
    profiles = profiles.withColumn("rest", F.col("g") - F.aggregate("floors", F.lit(0).cast("long"), lambda a, x: a + x))
    profiles = cut(profiles.withColumn("h", F.xxhash64("p", F.lit(seed))))
    left, line, rounded = profiles.filter("rest > 0"), None, profiles
    if left.count() > GREEDY:
        left = cut(grouped_prefix_sum(left, [], [F.desc("n"), "h", "p"], F.lit(1), before="place"))
        many = left.filter(F.col("place") >= GREEDY)
        line = cut(_line(many, names, shares, seed))
        rounded = profiles.join(many.select("p"), "p", "left_anti")
        left = left.filter(F.col("place") < GREEDY)

    one = lambda j: F.sum(F.get("floors", F.lit(j)) * F.col("x.n"))
    total = F.sum(F.col("g") * F.col("x.n"))
    state = rounded.select("g", "floors", F.explode("v").alias("x")).groupBy("x.label").agg(
        total.alias("all"), *[one(j).alias(f"has{j}") for j in range(len(names))],
    )
    if line is not None:
        at = lambda j: F.when(F.col("split") == F.lit(names[j]), F.col("x.n")).otherwise(F.lit(0).cast("long"))
        more = line.join(profiles.select("p", "v"), "p").select("split", F.explode("v").alias("x")).groupBy("x.label").agg(
            F.sum("x.n").alias("all"), *[F.sum(at(j)).alias(f"has{j}") for j in range(len(names))],
        )
        state = state.unionByName(more).groupBy("label").agg(*[F.sum(c).alias(c) for c in state.columns[1:]])
    state = state.withColumn("has", F.array(*[F.col(f"has{j}") for j in range(len(names))])).select(
        F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h"), F.col("label").alias("p"),
        F.lit(0).cast("long").alias("rest"), F.array(F.struct("label", F.col("all").alias("n"))).alias("v"), "has",
    )
    queue = left.select(F.lit(1).alias("kind"), F.col("n"), F.col("h"), "p", "rest", "v", F.lit(None).cast("array<long>").alias("has"))
    queue = state.unionByName(queue).repartition(1).sortWithinPartitions("kind", F.desc("n"), "h", "p").select("kind", "p", "rest", "v", "has")
    chosen = queue.mapInArrow(_greedy(names, shares), "p string, j long, split string")
    chosen = cut(chosen if line is None else chosen.unionByName(line))

    edge, split = F.lit(0), None
    for j, name in enumerate(names):
        edge = edge + F.get(floors, F.lit(j))
        split = F.when(F.col("i") < edge, F.lit(name)) if split is None else split.when(F.col("i") < edge, F.lit(name))
    placed = placed.select("k", "p", (F.col("i") - edge).alias("j"), split.alias("own"))
    # Components on the line were not rounded, whatever their place.
    placed = placed.join(chosen, ["p", "j"], "left").select("k", F.coalesce("split", "own").alias("split"))
    return join_one(rows, placed, "k", F.col("r")).select(F.col("r").alias(record), F.col("c").alias("component"), "split")


def _line(many: DataFrame, names: list[str], shares: list[float], seed: int) -> DataFrame:
    """``p, j, split`` of all components of the profiles, by the middles in the strata; ``j`` as of the left-over ones."""
    # The largest count wins, then the smaller label.
    first = F.array_min(F.transform("v", lambda x: F.struct((-x["n"]).alias("n"), x["label"].isNull().alias("none"), x["label"].alias("label"))))
    places = F.explode(F.sequence(F.col("rest") - F.col("g"), F.col("rest") - 1))
    each = many.select("p", "n", first["label"].alias("stratum"), places.alias("j")).withColumn("h", F.xxhash64("p", "j", F.lit(seed)))
    placed = grouped_prefix_sum(cut(each), ["stratum"], [F.desc("n"), "h", "p", "j"], "n", total="total")
    middle = (F.col("before") + F.col("n") / 2) / F.col("total")
    done, split = 0.0, None
    for name, share in zip(names, shares, strict=True):
        done += share
        split = F.when(middle <= done, F.lit(name)) if split is None else split.when(middle <= done, F.lit(name))
    return placed.select("p", "j", split.otherwise(F.lit(names[-1])).alias("split"))


def _greedy(names: list[str], shares: list[float]):
    """Rows ``p, j, split``: a split for each left-over component; the counts of the labels come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lacks: dict[str | None, list[float]] = {}
        whole = [0.0] * len(names)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["kind"] == 0:
                    x = r["v"][0]
                    lacks[x["label"]] = [s * x["n"] - h for s, h in zip(shares, r["has"], strict=True)]
                    whole = [w + k for w, k in zip(whole, lacks[x["label"]], strict=True)]
                    continue
                need = [(x["n"], lacks[x["label"]]) for x in r["v"]]
                n = sum(x for x, _ in need)
                for j in range(r["rest"]):
                    # What the squares grow by, halved: a count c more in a split that lacks d.
                    cost = [n * (n / 2 - whole[i]) + sum(x * (x / 2 - d[i]) for x, d in need) for i in range(len(names))]
                    best = min(range(len(names)), key=lambda i: (round(cost[i], 6), i))
                    whole[best] -= n
                    for x, d in need:
                        d[best] -= x
                    out.append((r["p"], j, names[best]))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["p", "j", "split"],
            )

    return run
