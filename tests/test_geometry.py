import pytest
from pyspark.sql import functions as F

from patchloom.operators import geometry, masks


def test_levels(slides):
    r = {
        x.path: x for x in slides.select(
            "path", geometry.best_level(0.7).alias("b"), geometry.best_level(0.75).alias("tie"), geometry.coarsest_level(0.7).alias("c"),
            geometry.mpp_at(1).alias("m"),
        ).collect()
    }
    a, b = r["memory://slide_0.svs"], r["memory://slide_1.svs"]
    assert (a.b, a.tie, a.c, a.m) == (1, 1, 1, 0.5)
    assert (b.b, b.c, b.m) == (0, 0, None)


def test_best_level_prefers_the_finer_on_a_tie(slides):
    assert slides.filter("path like '%slide_0%'").select(geometry.best_level(0.375).alias("b")).first().b == 0


@pytest.mark.parametrize(("stride", "n"), [(None, 256), (128, 961)])
def test_grid_counts(slides, stride, n):
    g = geometry.grid(slides.filter("path like '%slide_0%'"), 256, stride=stride)
    assert g.count() == n
    assert g.filter(F.col("x") % (stride or 256) != 0).isEmpty()


def test_grid_of_a_level_and_of_small_slides(slides):
    assert geometry.grid(slides.filter("width > 200"), 256, level=1).groupBy("path").count().select("count").distinct().first()[0] == 64
    assert geometry.grid(slides.filter("width = 200"), 256).isEmpty()
    with pytest.raises(Exception, match="lacks the level"):
        geometry.grid(slides, 64, level=2).collect()
    with pytest.raises(ValueError):
        geometry.grid(slides, 0)


def test_fraction_against_numpy(spark, slides):
    import numpy as np

    rng = np.random.default_rng(0)
    cells = (rng.random((7, 9)) < 0.5).astype(int)
    m = spark.createDataFrame(
        [("a", 9, 7, 10.0, cells.ravel().tolist())], "path string, mask_w int, mask_h int, downsample double, cells array<int>",
    )
    pts = [(int(x), int(y), int(s)) for x, y, s in zip(rng.integers(0, 120, 200), rng.integers(0, 120, 200), rng.integers(1, 60, 200))]
    c = spark.createDataFrame([("a", *p) for p in pts], "path string, x int, y int, footprint int")
    got = {(r.x, r.y, r.footprint): r.tissue_fraction for r in masks.fractions(c, m).collect()}
    for x, y, s in pts:
        x0, y0, k = min(int(x / 10), 8), min(int(y / 10), 6), max(1, int(s / 10))
        assert got[x, y, s] == pytest.approx(cells[y0 : min(y0 + k, 7), x0 : min(x0 + k, 9)].mean())


def test_shards(spark):
    df = spark.createDataFrame([(f"p{i:02d}",) for i in range(11)], "path string")
    assert sorted(r.path for r in geometry.rank_partition(df, "path", 1, 4).collect()) == ["p01", "p05", "p09"]
    got = {r.path: (r.shard, r.worker) for r in geometry.shards(df, "path", 4, 2).collect()}
    assert got["p04"] == (0, 1) and got["p08"] == (0, 0)
    with pytest.raises(ValueError):
        geometry.rank_partition(df, "path", 4, 4)


def test_view_centre(spark):
    x, y = geometry.view_centre(F.lit(0), F.lit(0), F.lit(1.0), 64, F.lit(4.0))
    assert tuple(spark.range(1).select(x, y).first()) == (-96, -96)


def test_masks(spark):
    rows = [("a", 0, 0, True), ("a", 0, 1, False), ("a", 1, 0, True), ("a", 1, 1, None)]
    cells = spark.createDataFrame(rows, "path string, my int, mx int, tissue boolean")
    assert masks.slide_fraction(cells).first().tissue_fraction == 0.5
    other = cells.withColumn("tissue", F.col("my") == 0)
    assert {(r.my, r.mx) for r in masks.combined(cells, other).filter("tissue").collect()} == {(0, 0)}
    with pytest.raises(ValueError):
        masks.combined()
    g = masks.gather(cells.fillna(False).withColumn("downsample", F.lit(2.0))).first()
    assert (g.mask_w, g.mask_h, g.cells) == (2, 2, [1, 0, 1, 0])
    s = {(r.my, r.mx): r.area for r in masks.summed(cells.fillna(False)).collect()}
    assert s[1, 1] == 2 and s[0, 1] == 1


def test_otsu_threshold_matches_numpy(spark):
    import numpy as np

    from patchloom.operators.images import otsu

    rng = np.random.default_rng(3)
    gray = np.concatenate([rng.normal(60, 10, 300), rng.normal(180, 20, 500)]).clip(0, 255).astype(np.uint8)
    df = spark.createDataFrame(
        [(1, int(g)) for g in gray] + [(2, 7)], "img int, gray int",
    ).groupBy("img", "gray").agg(F.count("*").alias("n"))
    got = {r.img: r.threshold for r in masks.otsu_threshold(df, ["img"]).collect()}
    assert got == {1: otsu(gray), 2: None}


def test_ranks_of_the_environment(spark, slides, monkeypatch):
    monkeypatch.setenv("RANK", "1")
    monkeypatch.setenv("WORLD_SIZE", "2")
    assert [r.path for r in geometry.rank_partition(slides, "path").collect()] == ["memory://slide_1.svs"]
    assert geometry.rank_partition(slides, "path", 0, 1).count() == 3
    with pytest.raises(RuntimeError, match="rank 4 of 5"):
        geometry.rank_partition(slides, "path", 4, 5)
