import json
import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from patchloom import viz
from patchloom.functions import udtf
from patchloom.operators import images
from patchloom.operators.views import View
from patchloom.plans import monitor
from patchloom.plans.pipeline import Pipeline
from patchloom.sources import datasource
from patchloom.sources.readers import Synthetic


def test_views_of_another_mpp(slides, full_masks):
    class Coded(Synthetic):
        """A gray value for each level."""

        def read(self, x, y, level, width, height):
            self._check()
            return np.full((height, width, 3), 80 + 40 * level, np.uint8)

    p = Pipeline(slides.filter("path like '%slide_0%'"), full_masks, seed=1).grid(64, shuffle=True).schedule(per_slide=3).read(Coded)
    v = p.views(View("near", count=2), View("far", mpp=1.0, patch_size=32))
    rows = v.patches().collect()
    assert len(rows) == 3
    for r in rows:
        assert set(r.views) == {"near_0", "near_1", "far"}
        assert r.views["near_0"]["data"][0] == 80 and r.views["far"]["data"][0] == 160 and r.views["far"]["height"] == 32
    assert next(v.batches(2))["far"].shape == (2, 3, 32, 32)
    with pytest.raises(ValueError):
        p.views(View("far", mpp=1.0), shared=[images.FlipRotate()])
    assert p.filter(images.HsvFilter()).views(View("a")).patches().isEmpty()
    bad = p.read(lambda: Coded(fail="slide_0")).views(View("a"))
    assert bad.patches().isEmpty()


def test_slides_source(spark):
    datasource.register(spark)
    df = spark.read.format("slides").option("paths", json.dumps([f"memory://{i}" for i in range(9)])).option("parts", 4).load()
    assert df.count() == 9 and df.rdd.getNumPartitions() == 4
    assert [r.path for r in df.filter("path = 'memory://3'").collect()] == ["memory://3"]
    assert df.filter("width > 5000").isEmpty()


def test_file_hits(spark, tmp_path):
    datasource.register(spark)
    hits = [
        {
            "file_id": str(i), "file_name": f"{i}.svs", "file_size": i, "cases": [{"project": {"project_id": "TCGA-A"}}] if i % 2 else [],
        } for i in range(25)
    ]
    (tmp_path / "hits.json").write_text(json.dumps({"data": {"hits": hits}}))
    df = spark.read.format("file_hits").option("url", str(tmp_path / "hits.json")).option("size", 10).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25
    from patchloom.operators.metadata import hits as flat

    assert flat(df).filter("cancer_type = 'unknown'").count() == 13


def test_udtf(spark):
    udtf.register(spark)
    spark.createDataFrame(
        [("a", 1024, 512), ("b", 10, 10), ("c", None, 5)], "path string, width int, height int",
    ).createOrReplaceTempView("udtf_slides")
    rows = spark.sql("SELECT path, x, y FROM udtf_slides s, LATERAL grid_cells(s.width, s.height, 256, 256)").collect()
    assert len(rows) == 8 and {r.path for r in rows} == {"a"}


def test_pictures(tmp_path):
    a = np.full((8, 6, 3), 200, np.uint8)
    viz.save_png(a, str(tmp_path / "sub/a.png"))
    data = (tmp_path / "sub/a.png").read_bytes()
    at = data.index(b"IDAT") + 4
    raw = zlib.decompress(data[at : data.index(b"IEND") - 8])
    assert data[:4] == b"\x89PNG" and len(raw) == 8 * (1 + 18) and raw[1] == 200
    m = np.zeros((4, 3), bool)
    m[0] = True
    o = viz.overlay(a, m, (0, 0, 0), 0.5)
    assert o[0, 0, 0] == 100 and o[7, 0, 0] == 200
    assert viz.patch_grid([a] * 5, columns=2, size=4, gap=1).shape == (16, 11, 3)
    assert viz.compare(a, {"flip": images.FlipRotate()}, size=8).shape[1] == 22
    assert viz.markers(a, [(50, 50)], (100, 100), radius=0)[4, 3].tolist() == [255, 0, 0]


def test_monitor(spark):
    seen = []
    loader = monitor.MonitoredLoader(({"image": np.zeros((4, 3))} for _ in range(5)), every=2, metrics=seen.append)
    assert sum(len(b["image"]) for b in loader) == 20
    assert len(seen) == 2 and seen[0]["patches_per_sec"] > 0 and loader.log(spark).count() == 5
    assert monitor.summary([]) == {}
    with monitor.PeakMemory(interval=0.01) as m:
        pass
    assert m.peak > 0


def test_benchmark(spark):
    got = monitor.benchmark(lambda n: spark.range(n), 4, 2, n=[10, 20])
    assert {r["patches"] for r in got} == {10, 20} and got[0]["patches_per_sec"] >= got[1]["patches_per_sec"]


def test_throughput_by_ranks(spark, slides):
    def make(s, size):
        paths = [r.path for r in s.collect()]
        while True:
            yield {"image": np.zeros((size, 1)), "slide_path": paths}

    got = monitor.throughput(make, slides, 2, warmup=2, measure=4, size=[8, 16]).collect()
    assert [r.world_size for r in got] == [2, 2] and {r.size for r in got} == {8, 16} and got[0].effective >= got[1].effective
    assert all(0 < r.effective <= r.aggregate + 1e-6 and r.peak_rss > 0 for r in got)
    assert monitor.throughput(make, slides, 9, size=8).isEmpty()


@pytest.mark.parametrize(
    ("script", "options", "said"),
    [("demo.py", [], "(16, 3, 256, 256)"), ("train.py", [], "mean colour"), ("figures.py", ["--out", "{tmp}"], "recipe_phikon")],
)
def test_examples_run(script, options, said, tmp_path):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run(
        [sys.executable, f"examples/{script}", *[o.format(tmp=tmp_path) for o in options]], cwd=root,
        env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert said in done.stdout
