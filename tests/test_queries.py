"""Every query with an SQL twin against the second engine, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from patchloom import queries as core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: f"{float(v):.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_against_sql(spark, name):
    df = core.queries()[name](spark, FOLDER)
    got = df.collect()
    if name not in core.oracle_sql():
        assert got
        return
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    want = db.sql(core.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_synthetic_patches(spark):
    from patchloom.catalog import slides

    got = core.queries()["synthetic_patches"](spark, FOLDER).collect()
    most = 100 * slides(spark, FOLDER).count()
    n = {r.path: 0 for r in got}
    for r in got:
        n[r.path] += 1
    # More than the two of each slide there once were, and the filter rejects some.
    assert 2 < max(n.values()) <= 100 and most / 4 < len(got) < most
    assert {(r.n_bytes, r.dtype, r.patch_size) for r in got} == {(256 * 256 * 3, "uint8", 256)}
    assert all(0 <= r.draw < 100 for r in got) and len({r.pixels for r in got}) > len(got) / 2


def test_pixels_by_a_second_reading(spark):
    """Some of the patches, made again one by one from the reader, the filter's formula and the transforms' equations."""
    import numpy as np
    import xxhash

    from patchloom.operators import images
    from patchloom.sources.readers import Stained

    rows = core.queries()["synthetic_patches"](spark, FOLDER).orderBy("pixels").limit(12).collect()
    for r in rows:
        reader = Stained()
        reader.open(r.path)
        a = reader.read(r.x, r.y, r.level, 256, 256)
        assert {tuple(c) for c in a.reshape(-1, 3).tolist()} <= {(240, 240, 240), (180, 110, 190)}
        # The stained colour lies in the filter's box (hue 146, saturation 107, value 190), the light one does not.
        assert (a[..., 1] == 110).mean() >= 0.6
        rng = images.generator(1, r.path, 0, r.draw, images.TRANSFORMS)
        h, v, turn = rng.random(3)
        a = a[:, ::-1] if h < 0.5 else a
        a = a[::-1] if v < 0.5 else a
        a = np.rot90(a, int(rng.integers(1, 4))) if turn < 0.5 else a
        u = rng.uniform(-1, 1, (3, 2)) * 0.05
        stains = -np.log(a / 255 + 1e-6) @ np.linalg.inv(images.STAINS) * (1 + u[:, 0]) + u[:, 1]
        exact = (np.exp(-stains @ images.STAINS) - 1e-6) * 255
        assert np.abs(exact - np.round(exact)).min() > 1e-6
        data = np.ascontiguousarray(exact.clip(0, 255).astype(np.uint8)).tobytes()
        assert xxhash.xxh64_intdigest(data, 42) == r.pixels % (1 << 64)


def test_entry(spark):
    assert entry.entry(spark).columns and not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
