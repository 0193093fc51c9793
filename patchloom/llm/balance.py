"""A sample of given category shares, allocated from the top of a category tree.

Categories are the leaves of a tree of any depth (``levels``, from the root down).  Going down,
the quota of a node is shared out among its children in proportion to their target shares,
between what each must and what it can have, in whole numbers by largest remainders: first as
if there were enough everywhere, which gives the quotas; then with the rows that there are.  In
that second pass a node keeps its quota as long as its own rows last, so what a leaf lacks goes to its
siblings, and only what these lack too to its cousins.  Leaves draw by rank in a hashed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import pick
from ..functions.rng import bits
from ..materialize import cut
from ..ranking import grouped_prefix_sum

#: More rows than any table has.
ENDLESS = 10**15


def key_of(value: Column) -> Column:
    """A category's letters and digits in lower case, with one blank between words; null if none is left."""
    text = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    return F.when(text != "", text)


def project_key(value: Column) -> Column:
    """:func:`key_of` of a project name whose prefix may be missing."""
    key = key_of(value)
    return F.when(key.startswith("tcga "), key).otherwise(F.concat(F.lit("tcga "), key))


def _shared_out(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """``got``: the whole-number part of its parent's ``q`` that each child gets.

    Children have ``w`` (weight), ``lo`` and ``hi``; ``q`` is at least the sum of ``lo``.  A child
    gets its weight times a factor, but at least ``lo`` and at most ``hi``; the factor is that for which
    the parts add up.  As a function of the factor the sum is linear between the points where a
    child leaves ``lo`` or reaches ``hi``, so the factor follows from running sums over these points.
    """
    node = Window.partitionBy(*parent)
    c = children.withColumn("_all_lo", F.sum("lo").over(node))
    points = F.array(*[F.struct(F.try_divide(F.col(v), F.col("w")).alias("t"), (F.col("w") * s).alias("dw")) for v, s in (("lo", 1), ("hi", -1))])
    c = c.withColumn("_e", F.when(F.col("w") > 0, points).otherwise(F.slice(points, 1, 0)))
    rows = c.withColumn("_e", F.explode_outer("_e"))
    up = Window.partitionBy(*parent).orderBy("_e.t").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_e.dw").over(up)).withColumn("_t", F.sum(F.col("_e.dw") * F.col("_e.t")).over(up))
    fits = F.col("_all_lo") + F.col("_e.t") * F.col("_s") - F.col("_t") <= F.col("q") + F.lit(1e-9)
    factor = F.when(F.col("_s") > 1e-12, F.try_divide(F.col("q") - F.col("_all_lo") + F.col("_t"), F.col("_s"))).otherwise(F.col("_e.t"))
    last = F.max(F.when(fits, F.struct(F.col("_e.t").alias("t"), factor.alias("f")))).over(node)
    rows = rows.withColumn("_f", F.coalesce(last["f"], F.lit(0.0))).drop("_e", "_s", "_t").distinct()
    part = F.when(F.col("w") > 0, F.least(F.col("hi").cast("double"), F.greatest(F.col("lo").cast("double"), F.col("_f") * F.col("w")))).otherwise(F.col("lo"))
    rows = rows.withColumn("_p", part).withColumn("_b", F.floor(F.col("_p") + F.lit(1e-9)).cast("long"))
    seat = F.row_number().over(
        Window.partitionBy(*parent).orderBy(F.when(F.col("_b") < F.col("hi"), 0).otherwise(1), F.desc(F.round(F.col("_p") - F.col("_b"), 9)), *order)
    )
    over = F.col("q") - F.sum("_b").over(node)
    got = F.col("_b") + F.when((F.col("_b") < F.col("hi")) & (seat <= over), 1).otherwise(0)
    return rows.withColumn("got", got.cast("long")).drop("_all_lo", "_f", "_p", "_b")


def _down(leaves: DataFrame, levels: list[str], size: Column, name: str) -> DataFrame:
    """The leaves with ``{name}_0`` (root), ..., ``{name}_d``: the quota of each node above them and of themselves.

    ``lo_k`` and ``hi_k`` are the bounds of the node at depth k, ``w`` the leaf's weight.
    """
    for k in range(1, len(levels) + 1):
        parent = levels[: k - 1]
        q = size if k == 1 else F.col(f"{name}_{k - 1}")
        own = leaves.groupBy(*levels[:k]).agg(
            F.sum("w").alias("w"), F.max(f"lo_{k}").alias("lo"), F.max(f"hi_{k}").alias("hi"), F.max(q.cast("long")).alias("q"),
        )
        got = _shared_out(own, parent, levels[k - 1 : k]).select(*levels[:k], F.col("got").alias(f"{name}_{k}"))
        leaves = leaves.join(got, levels[:k])
    return leaves


def allocate(
    available: DataFrame, targets: DataFrame, size: int, levels: list[str], *, share: str = "share", least: str = "least",
) -> DataFrame:
    """How many to draw of each leaf: ``*levels, share, least, wanted, quota, n_available, n_taken, n_extra, short``.

    ``wanted`` is the larger of ``least`` and ``share * size``.  ``quota`` is the leaf's part of ``size``
    if there were enough everywhere: quotas add up to ``size``, minima included, unless the minima alone
    are more.  ``n_taken`` adds up to the same, or to all rows there are; ``n_extra`` is what
    stands in for other leaves.  A leaf of share 0 gets its minimum and no more.  ``short``: fewer are available
    than wanted.  Targets are one small table, a row for each leaf; nulls, NaN and negative numbers in it count as a share or minimum of 0.
    """
    d = len(levels)
    t = targets.select(
        *levels, F.greatest(F.nanvl(F.coalesce(F.col(share).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.greatest(F.coalesce(F.col(least).cast("long"), F.lit(0)), F.lit(0)).alias("least"),
    )
    a = t.join(available.select(*levels, "n_available"), levels, "left").fillna(0, ["n_available"]).withColumn("w", F.col("share"))
    node = lambda k: Window.partitionBy(*levels[:k])

    most = F.when(F.col("w") > 0, F.lit(ENDLESS)).otherwise(F.col("least"))
    a = a.withColumns({f"lo_{k}": F.sum("least").over(node(k)) for k in range(1, d + 1)})
    a = a.withColumns({f"hi_{k}": F.sum(most).over(node(k)) for k in range(1, d + 1)})
    a = a.withColumn("_size", F.greatest(F.lit(size), F.sum("least").over(Window.partitionBy())))
    a = cut(_down(a, levels, F.col("_size"), "quota"))

    can = F.when(F.col("w") > 0, F.col("n_available")).otherwise(F.least(F.col("n_available"), F.col("least")))
    a = a.withColumns({f"hi_{k}": F.sum(can).over(node(k)) for k in range(1, d + 1)})
    a = a.withColumns({f"lo_{k}": F.least(f"quota_{k}", f"hi_{k}") for k in range(1, d + 1)})
    a = a.withColumn("_size", F.least("_size", F.sum(can).over(Window.partitionBy())))
    a = _down(a, levels, F.col("_size"), "taken")
    wanted = F.greatest(F.col("least").cast("double"), F.col("share") * F.lit(size))
    return a.select(
        *levels, "share", "least", wanted.alias("wanted"), F.col(f"quota_{d}").alias("quota"), "n_available", F.col(f"taken_{d}").alias("n_taken"),
        F.greatest(F.col(f"taken_{d}") - F.col(f"quota_{d}"), F.lit(0)).alias("n_extra"), (F.col("n_available") < wanted).alias("short"),
    )


def ranked(members: DataFrame, levels: list[str], *, id: str, seed: int = 0) -> DataFrame:
    """The members (``id, *levels``) with ``rank``, their place in a hashed order of their leaf, from 0."""
    keyed = cut(members.select(id, *levels, bits(seed, id).alias("_h"), F.lit(1).alias("_one")))
    return cut(grouped_prefix_sum(keyed, levels, ["_h", id], "_one", before="rank").select(id, *levels, "rank"))


class BalancedSample:
    """``plan`` (see :func:`allocate`) and ``sample`` for a table of items and one of targets.

    ``levels`` names the columns of the category tree, from the root down, in both tables; ``keys``
    undoes the spelling of each.  An item counts once, however many rows it has; of several values the
    largest after undoing the spelling counts.  Items that lack a value count for no
    category, and items of no target are not drawn.  Null ids name no item.  The sample has
    ``size`` rows, or else ``fraction`` of the items, rounded down.
    """

    def __init__(
        self, items: DataFrame, targets: DataFrame, *, id: str, levels: list[str], share: str, least: str, size: int | None = None,
        fraction: float = 0.25, keys: list | None = None, seed: int = 0,
    ):
        keys = keys or [key_of] * len(levels)
        own = [f"c{k}" for k in range(len(levels))]
        given = pick(items, _id=id, **dict(zip(own, levels, strict=True))).filter(F.col("_id").isNotNull())
        one = cut(given.groupBy("_id").agg(*[F.max(key(F.col(c))).alias(c) for c, key in zip(own, keys, strict=True)]))
        self.size = int(one.count() * fraction) if size is None else size
        full = " and ".join(f"{c} is not null" for c in own)
        shown = [f"n{k}" for k in range(len(levels))]
        named = pick(targets, **dict(zip(shown, levels, strict=True)), share=share, least=least)
        named = named.select(*[key(F.col(n)).alias(c) for n, c, key in zip(shown, own, keys, strict=True)], *shown, "share", "least").filter(full)
        # Of repeated targets the one with the largest share holds.
        named = cut(named.groupBy(*own).agg(F.max(F.struct("share", "least", *shown)).alias("t")).select(*own, "t.*"))
        placed = ranked(one.filter(full), own, id="_id", seed=seed)
        # As many as there are ranks.
        available = placed.groupBy(*own).agg((F.max("rank") + 1).alias("n_available"))
        plan = cut(allocate(available, named, self.size, own))
        names = named.select(*own, *shown)
        to = [F.col(n).alias(c) for n, c in zip(shown, levels, strict=True)]
        self.plan = plan.join(names, own).select(*to, *plan.columns[len(own) :])
        drawn = placed.join(plan.select(*own, "n_taken"), own).filter(F.col("rank") < F.col("n_taken"))
        self.sample = drawn.join(names, own).select(*to, F.col("_id").alias(id), "rank")
        self.levels = list(levels)

    def report(self) -> DataFrame:
        """The plan with the drawn numbers and shares, counted in the sample itself."""
        drawn = self.sample.groupBy(*self.levels).agg(F.count("*").alias("n_drawn"))
        all_ = F.sum("n_drawn").over(Window.partitionBy())
        return self.plan.join(drawn, self.levels, "left").fillna(0, ["n_drawn"]).withColumn(
            "actual_share", F.when(all_ > 0, F.col("n_drawn") / all_).otherwise(F.lit(0.0)),
        )
