"""Coordinate samplers.

Every draw is a pure function of (seed, slide, draw, attempt), so a sample is the
same for any partitioning and any draw can be made again alone.

Draws and grid cells are made and tested against the mask inside the slide's row, and only those
with tissue become rows of their own: slides meet their masks in one join, rejected attempts never
leave the row, and no further attempt is made once one has found tissue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import once
from ..functions.rng import bits_of, uniform
from .geometry import best_level, coarsest_level, crop_at, downsample_of, grid, sized, steps
from .masks import fraction_at, fractions_in, spans, sums_of, with_cells, with_sums

#: Entries of a cumulated distribution that are searched one by one.
BLOCK = 32
#: Cells of a grid that are tested at a time inside a task.
CELLS = 1 << 15


def _pick(u: Column, room: Column) -> Column:
    """A whole number from 0 to ``room``, both included."""
    return F.least(F.floor(u * (room + 1)), room).cast("int")


def draws(slides: DataFrame, n: int, seed: int, epoch: int = 0) -> DataFrame:
    """``n`` draws of each slide, with ``u_level``, a number for the choice of a magnification."""
    d = slides.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("u_level", uniform(seed, epoch, "path", "draw", F.lit("level")))


def attempt(seed: int | str, epoch: int | str, draw: Column, side: Column, retries: int, threshold: float) -> Column:
    """``attempt, x, y, tissue_fraction`` of the first of ``retries`` uniform positions of a square that has tissue, else nulls.

    In a row of :func:`.masks.with_sums` with ``width`` and ``height``.
    """
    width, height = F.col("width"), F.col("height")
    none = F.struct(*[F.lit(None).cast("int").alias(c) for c in ("attempt", "x", "y")], F.lit(None).cast("double").alias("tissue_fraction"))

    def position(t: Column) -> Column:
        lane = lambda name, room: _pick(uniform(seed, epoch, "path", draw, t, F.lit(name)), room - side)
        return F.struct(lane("x", width).alias("x"), lane("y", height).alias("y"))

    def one(found: Column, t: Column) -> Column:
        def look(c: Column) -> Column:
            hit = lambda f: F.when(f >= threshold, F.struct(t.alias("attempt"), c["x"].alias("x"), c["y"].alias("y"), f.alias("tissue_fraction"))).otherwise(none)
            return once(fraction_at(c["x"], c["y"], side), hit)

        # Nothing is computed any more once there is a position.
        return F.when(found["attempt"].isNotNull(), found).otherwise(once(position(t), look))

    fits = (side <= width) & (side <= height)
    # A mask with no tissue at all needs no attempts.
    some = F.lit(threshold <= 0) | (F.element_at("_sat", -1) > 0)
    return F.when(fits & some, F.aggregate(F.sequence(F.lit(0), F.lit(retries - 1)), none, one)).otherwise(none)


def drawn(slides: DataFrame, masks: DataFrame, n: int, draw, seed: int, retries: int, threshold: float, epoch: int | str = 0) -> DataFrame:
    """The slides' rows with the fields of ``n`` draws each, and for each the first of ``retries`` uniform positions that has tissue.

    ``draw(k, u)`` is the struct of draw ``k``, with a ``footprint``; ``u`` is its number for the choice of a
    magnification.  A footprint larger than the slide finds nothing.  Draws that find nothing have null
    ``x`` and ``y``.  ``epoch`` is a number, or a column that the slides have.
    """
    s = with_sums(slides, masks)
    tried = lambda d: attempt(seed, epoch, d["draw"], d["footprint"], retries, threshold)
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: draw(k, uniform(seed, epoch, "path", k, F.lit("level"))))
    both = F.transform(each, lambda d: F.struct(d.alias("d"), tried(d).alias("f")))
    rows = s.select(*_own(epoch), F.explode(both).alias("_r"))
    return rows.select(*_own(epoch), "_r.d.*", "_r.f.*")


def cells(
    slides: DataFrame, masks: DataFrame, patch_size: int = 256, level: Column | int = 0, stride: int | None = None, threshold: float = 0.4,
    keep: list[str] | None = None,
) -> DataFrame:
    """The cells of :func:`.geometry.grid` with tissue: ``path, x, y, level, patch_size, mpp, footprint, tissue_fraction``."""
    s = sized(with_sums(slides, masks), patch_size, level, stride)
    xs, ys = steps(F.col("width")), steps(F.col("height"))

    def row(y: Column) -> Column:
        cell = lambda x: F.struct(x.alias("x"), y.alias("y"), fraction_at(x, y, F.col("_p")).alias("tissue_fraction"))
        return F.filter(F.transform(xs, cell), lambda c: c["tissue_fraction"] >= threshold)

    s = s.select(
        "path", F.explode(F.flatten(F.transform(ys, row))).alias("_c"), (F.lit(level) if isinstance(level, int) else level).alias("level"),
        F.lit(patch_size).alias("patch_size"), (F.col("mpp") * F.col("_ds")).alias("mpp"), F.col("_p").alias("footprint"), *(keep or []),
    )
    return s.select("path", "_c.x", "_c.y", "level", "patch_size", "mpp", "footprint", "_c.tissue_fraction", *(keep or []))


def _own(epoch: int | str) -> list[str]:
    """What tells visits to slides apart: the path, and the epoch where it is a column."""
    return ["path", epoch] if isinstance(epoch, str) else ["path"]


def until_failures(rows: DataFrame, most: int, own: list[str] | None = None) -> DataFrame:
    """Draws of each visit to a slide up to the first ``most`` failures in a row (``x`` null), failures left out."""
    own = own or ["path"]
    order = Window.partitionBy(*own).orderBy("draw")
    r = rows.withColumn("_ok", F.col("x").isNotNull()).withColumn("_last", F.max(F.when(F.col("_ok"), F.col("draw"))).over(order))
    r = r.withColumn("_stop", F.when(F.col("draw") - F.coalesce("_last", F.lit(-1)) >= most, F.col("draw")))
    r = r.withColumn("_end", F.min("_stop").over(Window.partitionBy(*own)))
    return r.filter(F.col("_ok") & (F.col("_end").isNull() | (F.col("draw") < F.col("_end")))).drop("_ok", "_last", "_stop", "_end")


def random_coords(
    slides: DataFrame, masks: DataFrame, n: int, *, patch_size: int = 256, level: int = 0, target_mpp: float | None = None,
    threshold: float = 0.4, retries: int = 50, seed: int = 0, epoch: int | str = 0,
) -> DataFrame:
    """Uniform patches by rejection; the first draw that finds no tissue ends its slide."""
    if n < 1 or retries < 1 or patch_size < 1 or not 0 <= threshold <= 1:
        raise ValueError("n, retries and patch_size must be at least 1 and the threshold a share")
    s = slides.withColumn("level", best_level(target_mpp) if target_mpp else F.lit(level))
    s = s.withColumn("downsample", downsample_of(F.col("level"))).withColumn(
        "footprint", (F.lit(patch_size) * F.col("downsample")).cast("int"),
    )
    s = s.select(*_own(epoch), "width", "height", "level", (F.col("mpp") * F.col("downsample")).alias("mpp"), "footprint")
    draw = lambda k, u: F.struct(k.alias("draw"), *[F.col(c).alias(c) for c in ("level", "mpp", "footprint")])
    rows = until_failures(drawn(s, masks, n, draw, seed, retries, threshold, epoch), 1, _own(epoch))
    return rows.select(*_own(epoch), "draw", "x", "y", "level", F.lit(patch_size).alias("patch_size"), "mpp", "tissue_fraction")


def pool(coords: DataFrame, seed: int, size: int | None = None, epoch: int | str = 0, by: list[str] | None = None) -> DataFrame:
    """A shuffled pool without replacement: ``draw`` is the place in the permutation, cut at ``size``."""
    by = by or _own(epoch)
    order = [uniform(seed, epoch, "path", "level", "x", "y"), F.col("level"), F.col("y"), F.col("x")]
    p = coords.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    # The limit on the number itself lets Spark keep no more than ``size`` rows of each group while it sorts.
    p = p.filter(F.col("draw") <= size) if size else p
    return p.withColumn("draw", F.col("draw") - 1)


def cell_pool(
    slides: DataFrame, masks: DataFrame, size: int, *, patch_size: int = 256, level: int = 0, stride: int | None = None,
    threshold: float = 0.4, seed: int = 0, epoch: int | str = 0,
) -> DataFrame:
    """:func:`pool` of :func:`cells` cut at ``size``, in one pass: cells are tested and put in order inside the task, and only those drawn become rows."""
    own = _own(epoch)
    s = sized(with_cells(slides, masks), patch_size, level, stride).select(
        *own, "width", "height", "_ds", "_p", "_s", "mask_w", "mask_h", "downsample", "_cells", (F.col("mpp") * F.col("_ds")).alias("mpp"),
    )
    kind = lambda c: s.schema[c].dataType.simpleString()
    made = ", ".join([f"`{c}` {kind(c)}" for c in own] + [
        "x int, y int, level int, patch_size int, mpp double, footprint int, tissue_fraction double, draw int",
    ])
    types = {c: pa.int32() for c in ("x", "y", "level", "patch_size", "footprint", "draw")} | {c: pa.float64() for c in ("mpp", "tissue_fraction")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [c for c in b.schema.names if c != "_cells"]
            for i, values in enumerate(zip(*[b.column(c).to_pylist() for c in plain], strict=True)):
                r = dict(zip(plain, values, strict=True))
                if r["_ds"] is None:
                    raise ValueError("a slide lacks the level of the grid")
                key = [seed, r[epoch] if isinstance(epoch, str) else epoch, r["path"], level]
                x, y, tissue = _first_cells(r, sums_of(b.column("_cells")[i], r["mask_w"], r["mask_h"]), key, size, threshold)
                same = {"level": level, "patch_size": patch_size, "mpp": r["mpp"], "footprint": r["_p"]}
                each = {"x": x, "y": y, "tissue_fraction": tissue, "draw": np.arange(len(x))}
                columns = [pa.repeat(pa.scalar(r[c], b.schema.field(c).type), len(x)) for c in own]
                columns += [pa.array(each[c], t) if c in each else pa.repeat(pa.scalar(same[c], t), len(x)) for c, t in order]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *[c for c, _ in order]])

    order = [(c, types[c]) for c in ("x", "y", "level", "patch_size", "mpp", "footprint", "tissue_fraction", "draw")]
    return s.mapInArrow(run, made)


def _first_cells(r: dict, sums: np.ndarray, key: list, size: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x, y, tissue_fraction`` of the first ``size`` cells with tissue of a slide's grid, in the order of their hashes, ties by place.

    Some rows of the grid at a time; of the cells before them only the first ``size`` are held.
    """
    xs, ys = (np.arange(0, r[side] - r["_p"] + 1, r["_s"]) for side in ("width", "height"))
    mx, my = (spans(at, r["_p"], r["downsample"], n) for at, n in ((xs, r["mask_w"]), (ys, r["mask_h"])))
    held = [np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 2, np.zeros(0)]
    step = max(1, CELLS // len(xs))
    for top in range(0, len(ys), step):
        part = slice(top, top + step)
        tissue = fractions_in(sums, (my[0][part], my[1][part]), mx)
        y, x = np.nonzero(tissue >= threshold)
        new = [xs[x], ys[part][y], tissue[y, x]]
        new = [bits_of(key, new[0], new[1]), *new]
        if len(held[0]) == size:
            # Of equal hashes the earlier place is held.
            lower = new[0] < held[0][-1]
            new = [v[lower] for v in new]
        held = [np.concatenate(v) for v in zip(held, new, strict=True)]
        first = np.argsort(held[0], kind="stable")[:size]
        held = [v[first] for v in held]
    return held[1], held[2], held[3]


def pool_draws(coords: DataFrame, seed: int, most: int | None, opening: int | str = 0) -> DataFrame:
    """What the ``opening``-th visit to each slide draws from its pool, at most ``most`` at a time.

    The pool lives on from visit to visit: each takes the next places of the permutation, and the visit after
    the last place begins a new one.  So every cell comes once before any comes again.  ``draw`` counts from 0.
    """
    if most is None:
        return pool(coords, seed, None, opening)
    visit = Window.partitionBy(*_own(opening))
    nth = F.col(opening) if isinstance(opening, str) else F.lit(opening)
    c = coords.withColumn("_visits", F.ceil(F.count("*").over(visit) / most).cast("long"))
    c = c.withColumn("_pass", F.floor(nth / F.col("_visits")).cast("long")).withColumn("_slot", nth % F.col("_visits"))
    order = [uniform(seed, F.col("_pass"), "path", "level", "x", "y"), F.col("level"), F.col("y"), F.col("x")]
    c = c.withColumn("draw", F.row_number().over(visit.orderBy(*order)) - 1 - F.col("_slot") * most)
    return c.filter(F.col("draw").between(0, most - 1)).withColumn("draw", F.col("draw").cast("int")).drop("_visits", "_pass", "_slot")


def random_pool(
    slides: DataFrame, masks: DataFrame, n: int | None = None, *, patch_size: int = 256, level: int = 0, target_mpp: float | None = None,
    threshold: float = 0.4, seed: int = 0, opening: int | str = 0,
) -> DataFrame:
    """The random sampler without replacement: cells of the grid at the level (or the one closest to ``target_mpp``), shuffled."""
    s = slides.withColumn("_level", best_level(target_mpp) if target_mpp else F.lit(level))
    made = cells(s, masks, patch_size, F.col("_level"), threshold=threshold, keep=_own(opening)[1:])
    return pool_draws(made, seed, n, opening)


def level_weights(slides: DataFrame, targets: list[float], weights: list[float]) -> DataFrame:
    """``path, level, weight``: targets that fall on one level add their weights; weight 0 is left out."""
    check_weights(targets, weights)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in zip(targets, weights, strict=True)])
    s = slides.withColumn("_p", F.explode(pairs)).withColumn("level", best_level(F.col("_p.t")))
    return s.groupBy("path", "level").agg(F.sum("_p.w").alias("weight")).filter("weight > 0")


def check_weights(targets: list[float], weights: list[float]) -> None:
    if len(targets) != len(weights) or not targets or any(w < 0 for w in weights) or sum(weights) <= 0 or any(t <= 0 for t in targets):
        raise ValueError("targets must be positive, with as many weights, none negative and not all 0")


def race(coords: DataFrame, weights: DataFrame, seed: int, size: int | None = None, epoch: int | str = 0) -> DataFrame:
    """One order over the pools of several levels, each pop taking a level by the weights of those not yet empty.

    An exponential race: the k-th coordinate of a level arrives after the sum of k
    exponential waits of rate ``weight``.  Since the waits forget the past, the next
    arrival belongs to a level with the probability of its weight among those left.
    """
    p = coords if "weight" in coords.columns else coords.join(weights, ["path", "level"])
    own = _own(epoch)
    p = pool(p, seed, size, epoch, [*own, "level"])
    wait = -F.log(F.lit(1.0) - uniform(seed, epoch, "path", "level", "x", "y", F.lit("wait"))) / F.col("weight")
    order = Window.partitionBy(*own, "level").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("arrival", F.sum(wait).over(order)).withColumn("level_draw", F.col("draw"))
    p = p.withColumn("draw", F.row_number().over(Window.partitionBy(*own).orderBy(F.round("arrival", 9), "level", "level_draw")))
    p = p.filter(F.col("draw") <= size) if size else p
    return p.withColumn("draw", F.col("draw") - 1)


def multi_pool(
    slides: DataFrame, targets: list[float], weights: list[float], seed: int, *, patch_size: int = 256, size: int | None = None,
    epoch: int | str = 0, masks: DataFrame | None = None, threshold: float = 0.4,
) -> DataFrame:
    """Grids of the levels of several magnifications in one weighted order; a slide of unknown mpp has its level 0 alone."""
    w = level_weights(slides.select("path", "mpp", "levels").dropDuplicates(["path"]) if isinstance(epoch, str) else slides, targets, weights)
    on = slides.join(w.select("path", F.col("level").alias("lv"), "weight"), "path")
    if masks is None:
        made = grid(on, patch_size, F.col("lv"), keep=["weight", *_own(epoch)[1:]])
    else:
        made = cells(on, masks, patch_size, F.col("lv"), threshold=threshold, keep=["weight", *_own(epoch)[1:]])
    return race(made, w, seed, size, epoch)


def categorical(u: Column, values: list[float], weights: list[float]) -> Column:
    """The value whose share of the cumulated weights holds ``u``."""
    check_weights(values, weights)
    return _chosen(u, values, weights)


def _chosen(u: Column, values: list, weights: list[float]) -> Column:
    total, done = float(sum(weights)), 0.0
    live = [(v, w) for v, w in zip(values, weights, strict=True) if w > 0]
    chosen: Column | None = None
    for v, w in live[:-1]:
        done += w
        edge = F.lit(done / total)
        chosen = F.when(u < edge, F.lit(v)) if chosen is None else chosen.when(u < edge, F.lit(v))
    last = F.lit(live[-1][0])
    return last if chosen is None else chosen.otherwise(last)


def multi_magnification(
    slides: DataFrame, masks: DataFrame, n: int, *, targets=(0.25, 0.5, 1.0, 2.0), weights=None, patch_size: int = 256,
    threshold: float = 0.4, retries: int = 50, most_failures: int = 100, seed: int = 0, epoch: int | str = 0,
) -> DataFrame:
    """Draw a magnification, then a patch of its level; a slide ends after ``most_failures`` draws in a row without tissue."""
    # What each target means on a slide is worked out once a slide, and looked up by each draw.
    live = [(float(t), float(w)) for t, w in zip(targets, weights or [1.0] * len(targets), strict=True)]
    check_weights([t for t, _ in live], [w for _, w in live])

    def choice(target: float | None) -> Column:
        level = F.lit(0) if target is None else best_level(target)
        ds = downsample_of(level)
        return F.struct(
            level.cast("int").alias("level"), F.lit(target).cast("double").alias("target"), (F.col("mpp") * ds).alias("mpp"),
            (F.lit(patch_size) * ds).cast("int").alias("footprint"),
        )

    s = slides.select(*_own(epoch), "width", "height", "mpp", F.array(*[choice(t) for t, _ in live]).alias("_of"), choice(None).alias("_none"))

    def draw(k: Column, u: Column) -> Column:
        at = _chosen(u, list(range(len(live))), [w for _, w in live])
        fields = lambda c: F.struct(k.alias("draw"), *[c[f].alias(f) for f in ("level", "target", "mpp", "footprint")])
        return once(F.when(F.col("mpp").isNull(), F.col("_none")).otherwise(F.get("_of", at)), fields)

    rows = until_failures(drawn(s, masks, n, draw, seed, retries, threshold, epoch), most_failures, _own(epoch))
    return rows.select(*_own(epoch), "draw", "x", "y", "level", "target", F.lit(patch_size).alias("patch_size"), "mpp", "tissue_fraction")


# -- continuous magnification ------------------------------------------------


def mpp_grid(spark, low: float, high: float, points: int) -> DataFrame:
    """``i, x``: evenly spaced magnifications, both ends included."""
    if not 0 < low < high or points < 2:
        raise ValueError("the mpp range must be positive and rising, with at least two points")
    return spark.range(points).select(
        F.col("id").cast("int").alias("i"), (F.lit(float(low)) + F.col("id") * F.lit((high - low) / (points - 1))).alias("x"),
    )


def maxavg_weights(spark, low: float = 0.25, high: float = 2.0, lam: float = 1.0, points: int = 1000) -> DataFrame:
    """``i, x, p, cdf``: p in proportion to exp(k / lam) with k = 4x/3 - a^3 / 3x^2 - x^2 / b, the transfer to all other magnifications."""
    if lam <= 0:
        raise ValueError("lam must be positive")
    x = F.col("x")
    k = x * (4 / 3) - F.lit(low**3) / (x * x * 3) - x * x / F.lit(high)
    all_ = Window.partitionBy()
    g = mpp_grid(spark, low, high, points).withColumn("k", k / F.lit(lam))
    return _with_cdf(g.withColumn("w", F.exp(F.col("k") - F.max("k").over(all_))))


def minmax_weights(spark, low: float = 0.25, high: float = 2.0, points: int = 100) -> DataFrame:
    """``i, x, p, cdf``: the weights whose worst transfer is best, for the kernel (min / max)^2.

    The kernel is symmetric and has positive weights that make the transfer the same
    everywhere; these solve the linear program.  With r the kernel of neighbours they
    are 1/(1 + r) at the ends and 1/(1 + r before) + 1/(1 + r after) - 1 between.
    """
    order = Window.orderBy("i")
    sq = lambda c: c * c
    g = mpp_grid(spark, low, high, points)
    g = g.withColumn("_l", 1 / (1 + sq(F.lag("x").over(order) / F.col("x")))).withColumn(
        "_r", 1 / (1 + sq(F.col("x") / F.lead("x").over(order))),
    )
    w = F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull(), F.col("_l")).otherwise(F.col("_l") + F.col("_r") - 1)
    return _with_cdf(g.withColumn("w", w))


def _with_cdf(g: DataFrame) -> DataFrame:
    up = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("w") / F.sum("w").over(Window.partitionBy())
    return g.select("i", "x", p.alias("p")).withColumn("cdf", F.sum("p").over(up))


def continuous(
    slides: DataFrame, masks: DataFrame, n: int, *, output_size: int = 224, low: float = 0.25, high: float = 2.0,
    cdf: DataFrame | None = None, threshold: float = 0.4, retries: int = 50, most_failures: int = 100, seed: int = 0, epoch: int | str = 0,
) -> DataFrame:
    """Patches of a magnification drawn uniformly, or from ``cdf`` (``x, cdf``, a table of fixed length).

    The magnification, the finer level and the crop follow; crops larger than the slide
    and draws without tissue count as failures.  A slide of unknown mpp is sampled at level 0.
    """
    s = slides.select(*_own(epoch), "width", "height", "mpp", "levels")
    if cdf is not None:
        # One array row, as long as the fixed grid.
        one = cdf.agg(F.array_sort(F.collect_list(F.struct("cdf", "x"))).alias("_c"))
        s = s.crossJoin(F.broadcast(one))

    def target(u: Column) -> Column:
        if cdf is None:
            return F.lit(low) + F.lit(high - low) * u
        # The first entry above u: its block of BLOCK entries by the blocks' first ones, then inside the block.
        firsts = F.transform(F.sequence(F.lit(0), F.size("_c") - 1, F.lit(BLOCK)), lambda i: F.get("_c", i)["cdf"])
        start = F.greatest(F.size(F.filter(firsts, lambda e: e <= u)) - 1, F.lit(0)) * BLOCK
        at = start + F.size(F.filter(F.slice("_c", start + 1, BLOCK), lambda e: e["cdf"] <= u))
        return F.get("_c", F.least(at, F.size("_c") - 1))["x"]

    def draw(k: Column, u: Column) -> Column:
        def known(t: Column) -> Column:
            def placed(level: Column) -> Column:
                def sized_(ds: Column) -> Column:
                    crop, side = crop_at(t, ds, output_size)
                    return F.struct(
                        k.alias("draw"), level.alias("level"), crop.alias("patch_size"), t.alias("mpp"), side.alias("footprint"),
                    )

                return once(downsample_of(level), sized_)

            return once(coarsest_level(t), placed)

        unknown = F.struct(
            k.alias("draw"), F.lit(0).alias("level"), F.lit(output_size).alias("patch_size"), F.lit(None).cast("double").alias("mpp"),
            F.floor(F.lit(output_size) * downsample_of(0)).cast("int").alias("footprint"),
        )
        return F.when(F.col("mpp").isNull(), unknown).otherwise(once(target(u), known))

    rows = until_failures(drawn(s, masks, n, draw, seed, retries, threshold, epoch), most_failures, _own(epoch))
    return rows.select(*_own(epoch), "draw", "x", "y", "level", "patch_size", "mpp", "footprint", "tissue_fraction")


def stratified(df: DataFrame, by: Column, most: int, order: Column, tie: str) -> DataFrame:
    """At most ``most`` rows of each stratum, without replacement, in hashed order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, tie))).filter(F.col("_r") <= most).drop("_r")


def slide_order(slides: DataFrame, seed: int, epoch: int | str = 0, shuffled: bool = True) -> DataFrame:
    """``pos``, the place of each slide in the (epoch's) order: random, or that of the paths."""
    from ..materialize import cut
    from ..ranking import grouped_prefix_sum

    keyed = cut(slides.withColumn("_u", uniform(seed, epoch, "path") if shuffled else F.lit(0.0)))
    return grouped_prefix_sum(keyed, _own(epoch)[1:], ["_u", "path"], F.lit(1), before="pos").drop("_u")
