from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import geometry, masks, sampling


def test_random_is_the_same_for_any_partitioning(slides, full_masks):
    a = sampling.random_coords(slides, full_masks, 20, seed=1).select("path", "draw", "x", "y")
    b = sampling.random_coords(slides.repartition(7), full_masks, 20, seed=1).select("path", "draw", "x", "y")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    n = Counter(r.path for r in a.collect())
    assert n == {"memory://slide_0.svs": 20, "memory://slide_1.svs": 20}  # the tiny slide has no room
    assert a.filter("x < 0 or y < 0 or x > 3840 or y > 3840").isEmpty()
    c = sampling.random_coords(slides, full_masks, 20, seed=2).select("path", "draw", "x", "y")
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, c.collect()))


def test_no_tissue_gives_nothing(slides, full_masks):
    none = full_masks.withColumn("cells", F.array_repeat(F.lit(0), 10000))
    assert sampling.random_coords(slides, none, 5, retries=3).isEmpty()


def test_target_mpp_picks_the_level(slides, full_masks):
    r = sampling.random_coords(
        slides, full_masks, 3, target_mpp=1.0,
    ).filter("path like '%slide_0%'").select("level", "mpp").distinct().collect()
    assert [tuple(x) for x in r] == [(2, 1.0)]


def test_until_failures(spark):
    rows = [("a", i, None if i in (2, 3, 5, 6, 7) else i) for i in range(10)]
    df = spark.createDataFrame(rows, "path string, draw int, x int")
    keep = lambda most: sorted(r.draw for r in sampling.until_failures(df, most).collect())
    assert keep(1) == [0, 1]
    assert keep(2) == [0, 1]
    assert keep(3) == [0, 1, 4]
    assert keep(4) == [0, 1, 4, 8, 9]


def test_pool_is_a_permutation_and_cut_without_bias(slides):
    g = geometry.grid(slides.filter("path like '%slide_0%'"), 256)
    p = sampling.pool(g, seed=5)
    assert sorted(r.draw for r in p.collect()) == list(range(256))
    cut = sampling.pool(g, seed=5, size=40)
    assert cut.count() == 40
    assert 1000 < cut.agg(F.avg("x")).first()[0] < 2840


def test_cells_drawn_in_the_task_are_those_of_the_pool(slides, full_masks):
    part = full_masks.withColumn("cells", F.transform("cells", lambda c, i: F.when((i % 100 < 40) & (i < 7000), c).otherwise(0)))
    s = slides.withColumn("epoch", F.lit(3))
    for size, stride, epoch in ((9, None, "epoch"), (10000, 100, 2)):
        keep = ["epoch"] if epoch == "epoch" else []
        want = sampling.pool(sampling.cells(s, part, 256, 0, stride, keep=keep), 5, size, epoch)
        got = sampling.cell_pool(s, part, size, stride=stride, seed=5, epoch=epoch)
        assert dict(got.dtypes) == dict(want.dtypes)
        rows = sorted(map(tuple, got.select(*want.columns).collect()))
        assert rows == sorted(map(tuple, want.collect())) and len(rows) >= 18
    with pytest.raises(Exception, match="lacks the level"):
        sampling.cell_pool(s, part, 9, level=2).collect()


def test_few_cells_at_a_time_and_ties(monkeypatch):
    r = {"width": 4096, "height": 2048, "_p": 256, "_s": 128, "mask_w": 4, "mask_h": 2, "downsample": 1024.0}
    sums = np.zeros((3, 5), np.int32)
    sums[1:, 1:] = np.array([[1, 1, 0, 1], [0, 1, 1, 1]]).cumsum(0).cumsum(1)
    monkeypatch.setattr(sampling, "bits_of", lambda key, x, y: ((x + y) // 512).astype(np.uint32))
    want = [v.tolist() for v in sampling._first_cells(r, sums, [], 50, 0.4)]
    monkeypatch.setattr(sampling, "CELLS", 70)
    assert [v.tolist() for v in sampling._first_cells(r, sums, [], 50, 0.4)] == want
    order = [((x + y) // 512, y, x) for x, y in zip(*want[:2], strict=True)]
    assert order == sorted(order) and len(set(order)) == 50


def test_hashes_inside_a_task():
    from hashlib import md5

    from patchloom.functions.rng import bits_of

    x, y = np.array([0, 9, 10, 99, 12345, 2**31 - 1, 7]), np.array([0, 100, 2**31 - 1, 5, 67890, 2**31 - 1, 10])
    for n in range(130):
        parts = [1, 0, "\u00fc" + "p" * n, 2]
        want = [int(md5("|".join(map(str, [*parts, a, b])).encode()).hexdigest()[:8], 16) for a, b in zip(x, y, strict=True)]
        assert bits_of(parts, x, y).tolist() == want


def test_race_follows_the_weights(spark):
    n = 500
    rows = [("s", lv, i, 0) for lv in (0, 1) for i in range(n)]
    c = spark.createDataFrame(rows, "path string, level int, x int, y int")
    w = spark.createDataFrame([("s", 0, 0.9), ("s", 1, 0.1)], "path string, level int, weight double")
    first = Counter(r.level for r in sampling.race(c, w, 1).filter("draw < 200").collect())
    assert first[0] > 3 * first[1]
    assert sampling.race(c, w, 1, 5).count() == 5
    short = spark.createDataFrame(
        [("s", lv, i, 0) for lv, k in ((0, 3), (1, 100)) for i in range(k)], "path string, level int, x int, y int",
    )
    got = Counter(r.level for r in sampling.race(short, w, 2).collect())
    assert got == {0: 3, 1: 100}


def test_level_weights_add_up(slides):
    got = {(r.path, r.level): r.weight for r in sampling.level_weights(slides, [0.25, 0.5, 1.0, 2.0], [0.4, 0.3, 0.2, 0.1]).collect()}
    assert got["memory://slide_0.svs", 2] == pytest.approx(0.3)
    assert got["memory://slide_1.svs", 0] == pytest.approx(1.0)
    assert ("memory://slide_0.svs", 1) in got
    zero = sampling.level_weights(slides, [0.25, 0.5], [1.0, 0.0]).filter("path like '%slide_0%'")
    assert [r.level for r in zero.collect()] == [0]
    for bad in ([1.0], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            sampling.level_weights(slides, [0.25, 0.5], bad)


def test_categorical_frequencies(spark):
    u = spark.range(10000).select((F.col("id") / 10000.0).alias("u"))
    n = Counter(r.v for r in u.select(sampling.categorical(F.col("u"), [1.0, 2.0, 3.0], [1, 0, 3]).alias("v")).collect())
    assert n == {1.0: 2500, 3.0: 7500}


def test_minmax_makes_the_transfer_equal(spark):
    import numpy as np

    rows = sampling.minmax_weights(spark, points=50).orderBy("i").collect()
    x, p = np.array([r.x for r in rows]), np.array([r.p for r in rows])
    k = (np.minimum.outer(x, x) / np.maximum.outer(x, x)) ** 2
    assert p.min() > 0 and np.ptp(k @ p) < 1e-12 and p.sum() == pytest.approx(1)


def test_maxavg_formula(spark):
    import numpy as np

    rows = sampling.maxavg_weights(spark, 0.25, 2.0, 0.5, 200).orderBy("i").collect()
    x = np.linspace(0.25, 2.0, 200)
    k = 4 * x / 3 - 0.25**3 / (3 * x**2) - x**2 / 2.0
    w = np.exp((k - k.max()) / 0.5)
    assert np.allclose([r.p for r in rows], w / w.sum(), atol=1e-12)
    assert rows[-1].cdf == pytest.approx(1)


def test_continuous_crop_size(slides, full_masks):
    import numpy as np

    for r in sampling.continuous(slides, full_masks, 30, seed=3).collect():
        if "slide_0" in r.path:
            ds = 2.0**r.level
            assert r.patch_size == max(1, round(224 * r.mpp / (0.25 * ds)))
            assert 0.25 <= r.mpp <= 2.0 and 0.25 * ds <= r.mpp + 1e-12
            assert r.footprint == int(np.rint(r.patch_size * ds))
        else:
            assert r.mpp is None and r.level == 0 and r.patch_size == 224 or "slide_1" not in r.path


def test_continuous_from_a_table(spark, slides, full_masks):
    cdf = sampling.maxavg_weights(spark, points=100).select("x", "cdf")
    got = sampling.continuous(slides.filter("mpp is not null"), full_masks, 20, cdf=cdf, seed=3)
    assert got.count() > 10 and got.filter("mpp < 0.25 or mpp > 2").isEmpty()


def test_multi_magnification(slides, full_masks):
    rows = sampling.multi_magnification(slides, full_masks, 50, seed=4).collect()
    assert {r.level for r in rows if "slide_0" in r.path} == {0, 1, 2}
    assert {r.level for r in rows if "slide_1" in r.path} == {0}


def test_stratified_and_order(spark):
    df = spark.createDataFrame([(f"f{i}", "a" if i % 2 else None) for i in range(20)], "f string, c string")
    n = Counter(r.c for r in sampling.stratified(df, F.col("c"), 3, F.md5("f"), "f").collect())
    assert n == {"a": 3, None: 3}
    s = spark.createDataFrame([(f"f{i}",) for i in range(20)], "path string")
    a = {r.path: r.pos for r in sampling.slide_order(s, 1, 0).collect()}
    b = {r.path: r.pos for r in sampling.slide_order(s, 1, 1).collect()}
    assert sorted(a.values()) == list(range(20)) and a != b


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, slides, full_masks):
    one = sampling.random_coords(slides, full_masks, 5)
    # Slides meet masks in a merge join, and only there; attempts are not rows.
    assert plan_of(one).count("SortMergeJoin") == 1 and "Broadcast" not in plan_of(one) and plan_of(one).count("Generate explode") == 1
    assert "Broadcast" not in plan_of(sampling.cells(slides, full_masks, 256)) and "Broadcast" not in plan_of(sampling.random_pool(slides, full_masks, 5))
    assert "WindowGroupLimit" in plan_of(sampling.pool(geometry.grid(slides.filter("width > 1000"), 512), 1, 5))
    w = sampling.level_weights(slides, [0.25, 1.0], [0.5, 0.5])
    assert plan_of(sampling.race(geometry.grid(slides.filter("width > 1000"), 512), w, 1, 5)).count("WindowGroupLimit") >= 2


def test_full_size_packed_masks(spark, slides):
    """2048 x 2048 cells as bits: tissue in the left half, looked up by samplers and for given coordinates."""
    mask = np.zeros((2048, 2048), bool)
    mask[:, :1024] = True
    rows = [(r.path, 2048, 2048, r.width / 2048, np.packbits(mask.ravel()).tobytes()) for r in slides.filter("width > 1000").collect()]
    m = spark.createDataFrame(rows, "path string, mask_w int, mask_h int, downsample double, cells binary")
    c = sampling.cells(slides, m, 256, threshold=0.5).collect()
    assert len(c) == 2 * 8 * 16 and all(r.x < 2048 and r.tissue_fraction == 1 for r in c)
    r = sampling.random_coords(slides, m, 20, threshold=0.75).collect()
    assert len(r) == 40 and all(x.x <= 2048 - 192 + 1 for x in r)
    given = spark.createDataFrame([(rows[0][0], x, 0, 256) for x in (0, 1920, 2048)], "path string, x int, y int, footprint int")
    assert [x.tissue_fraction for x in masks.fractions(given, m).orderBy("x").collect()] == [1.0, 0.5, 0.0]
