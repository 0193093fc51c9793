"""Queries of the engine's operators over whole tables, with SQL twins for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CELLS, HSV, LEVELS, PIXELS, SLIDES, mask_cells, masks, pixels, plane, slides, table
from .functions import pixels as px
from .functions.rng import bits, bits_sql, uniform, uniform_sql
from .materialize import cut
from .operators import geometry, images, metadata, sampling, schedule, stats
from .operators import masks as tissue
from .ranking import grouped_prefix_sum

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TARGETS, WEIGHTS = [0.25, 0.5, 1.0, 2.0], [0.4, 0.3, 0.2, 0.1]


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- geometry ----------------------------------------------------------------


@query(f"WITH {SLIDES}, {LEVELS} SELECT path, level, ds AS downsample, round(mpp * ds, 6) AS level_mpp FROM lv")
def slide_levels(spark, d):
    s = slides(spark, d).select("path", "mpp", F.explode("levels").alias("l"))
    return s.select("path", "l.level", "l.downsample", F.round(F.col("mpp") * F.col("l.downsample"), 6).alias("level_mpp"))


_BEST = """best AS (
  SELECT path, target, CASE WHEN any_value(mpp) IS NULL THEN 0 ELSE arg_min(level, (abs(mpp * ds - target), level)) END AS level
  FROM lv, (SELECT unnest([0.25::DOUBLE, 0.5, 1.0, 2.0]) AS target) GROUP BY path, target)"""


@query(f"WITH {SLIDES}, {LEVELS}, {_BEST} SELECT path, target, level FROM best")
def best_level(spark, d):
    s = slides(spark, d).withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    return s.select("path", "target", geometry.best_level(F.col("target")).alias("level"))


@query(f"WITH {SLIDES}, {LEVELS} SELECT path, coalesce(max(level) FILTER (ds * mpp <= 0.7::DOUBLE), 0) AS level FROM lv GROUP BY path")
def coarsest_level(spark, d):
    return slides(spark, d).select("path", geometry.coarsest_level(0.7).alias("level"))


def _grid_sql(patch: int, stride: int) -> str:
    return f"""g0 AS (SELECT path, width, height, mpp * ds AS mpp, trunc({patch} * ds)::INT AS p, trunc({stride} * ds)::INT AS s FROM lv WHERE level = 0),
      g1 AS (SELECT *, unnest(range(0, height - p + 1, s))::INT AS y FROM g0 WHERE height >= p AND width >= p),
      grid AS (SELECT *, unnest(range(0, width - p + 1, s))::INT AS x FROM g1)"""


@query(
    f"WITH {SLIDES}, {LEVELS}, {_grid_sql(2048, 2048)} SELECT path, x, y, 0 AS level, 2048 AS patch_size, round(mpp, 6) AS mpp FROM grid"
)
def grid_coords(spark, d):
    return geometry.grid(slides(spark, d), 2048).select("path", "x", "y", "level", "patch_size", F.round("mpp", 6).alias("mpp"))


@query(
    f"WITH {SLIDES}, {LEVELS}, {_grid_sql(4096, 2048)} SELECT path, count(*) AS n, max(x) AS max_x, max(y) AS max_y, sum(x::BIGINT + y)::BIGINT AS total FROM grid GROUP BY path"
)
def grid_stride_coords(spark, d):
    g = geometry.grid(slides(spark, d), 4096, stride=2048)
    return g.groupBy("path").agg(
        F.count("*").alias("n"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.sum(F.col("x").cast("long") + F.col("y")).alias("total"),
    )


def _fraction_sql(src: str, name: str) -> str:
    """CTE ``name``: the columns of ``src`` with the mean of the mask cells under (x, y, p)."""
    return f"""m_{name} AS (SELECT s.*, q.downsample, least(trunc(x / downsample)::INT, 15) AS mx0, least(trunc(y / downsample)::INT, 15) AS my0, greatest(1, trunc(p / downsample)::INT) AS mw
        FROM {src} s JOIN (SELECT DISTINCT path, downsample FROM cells) q USING (path)),
      {name} AS (SELECT m.* EXCLUDE (downsample, mx0, my0, mw), f.frac FROM m_{name} m JOIN (
          SELECT k.path, k.mx0, k.my0, k.mw, avg(c.tissue::INT) AS frac FROM (SELECT DISTINCT path, mx0, my0, mw FROM m_{name}) k
          JOIN cells c ON c.path = k.path AND c.mx >= k.mx0 AND c.mx < k.mx0 + k.mw AND c.my >= k.my0 AND c.my < k.my0 + k.mw GROUP BY 1, 2, 3, 4) f
        ON f.path = m.path AND f.mx0 = m.mx0 AND f.my0 = m.my0 AND f.mw = m.mw)"""


_GRID_FRACTION = f"WITH {SLIDES}, {LEVELS}, {CELLS}, {_grid_sql(2048, 2048)}, {_fraction_sql('grid', 'fr')}"


def _grid_fraction(spark, d):
    s = slides(spark, d)
    return tissue.fractions(geometry.grid(s, 2048), masks(s))


@query(
    f"{_GRID_FRACTION} SELECT path, count(*) AS n, round(sum(frac), 6) AS sum_fraction, round(max(frac), 6) AS max_fraction FROM fr GROUP BY path"
)
def tissue_fraction(spark, d):
    f = F.col("tissue_fraction")
    return _grid_fraction(spark, d).groupBy("path").agg(
        F.count("*").alias("n"), F.round(F.sum(f), 6).alias("sum_fraction"), F.round(F.max(f), 6).alias("max_fraction"),
    )


@query(f"{_GRID_FRACTION} SELECT path, x, y, 0 AS level, round(mpp, 6) AS mpp, round(frac, 6) AS tissue_fraction FROM fr WHERE frac >= 0.4")
def tissue_grid(spark, d):
    s = slides(spark, d)
    return sampling.cells(s, masks(s), 2048).select(
        "path", "x", "y", "level", F.round("mpp", 6).alias("mpp"), F.round("tissue_fraction", 6).alias("tissue_fraction"),
    )


@query(f"WITH {SLIDES}, {CELLS} SELECT path, round(avg(tissue::INT), 6) AS tissue_fraction, count(*) AS n_cells FROM cells GROUP BY path")
def slide_tissue_stats(spark, d):
    return tissue.slide_fraction(mask_cells(slides(spark, d))).withColumn("tissue_fraction", F.round("tissue_fraction", 6))


@query(
    f"WITH {SLIDES}, {CELLS} SELECT a.path, a.my, a.mx, sum(b.tissue::INT)::BIGINT AS area FROM cells a JOIN cells b ON a.path = b.path AND b.my <= a.my AND b.mx <= a.mx GROUP BY 1, 2, 3"
)
def mask_sums(spark, d):
    return tissue.summed(mask_cells(slides(spark, d))).select("path", "my", "mx", "area")


_COMBINED = f"""WITH {SLIDES}, {CELLS} SELECT path, sum((tissue AND (mx + my) % 3 <> 0)::INT)::BIGINT AS n_tissue, count(*) AS n FROM cells GROUP BY path"""


@query(_COMBINED)
def combined_mask(spark, d):
    a = mask_cells(slides(spark, d)).drop("downsample")
    both = tissue.combined(a, a.withColumn("tissue", (F.col("mx") + F.col("my")) % 3 != 0))
    return both.groupBy("path").agg(F.sum(F.col("tissue").cast("int")).alias("n_tissue"), F.count("*").alias("n"))


_ORDERED = f"{SLIDES}, o AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM sl)"


@query(f"WITH {_ORDERED} SELECT path FROM o WHERE i % 4 = 1")
def rank_partition(spark, d):
    return geometry.rank_partition(slides(spark, d).select("path"), "path", 1, 4)


@query(f"WITH {_ORDERED} SELECT path, (i % 4)::INT AS shard, (i // 4 % 3)::INT AS worker FROM o")
def worker_partition(spark, d):
    return geometry.shards(slides(spark, d).select("path"), "path", 4, 3)


@query("SELECT path, count(*) AS n FROM slides GROUP BY path HAVING count(*) > 1")
def duplicate_paths(spark, d):
    return geometry.duplicate_paths(table(spark, d, "slides"))


# -- sampling ----------------------------------------------------------------


def _attempt_sql(src: str, seed: int, tries: int) -> str:
    """CTEs up to ``hit``: the first position of each draw of ``src`` (path, draw, width, height, p, ...) with tissue."""
    pick = lambda lane, room: f"least(floor({uniform_sql(seed, 0, 'path', 'draw', 'tryno', repr(lane))} * ({room} + 1)), {room})::INT"
    return f"""t0 AS (SELECT path, draw, width, height, p, tryno::INT AS tryno FROM {src}, range({tries}) r(tryno) WHERE p <= width AND p <= height),
      t1 AS (SELECT path, draw, tryno, p, {pick('x', 'width - p')} AS x, {pick('y', 'height - p')} AS y FROM t0),
      {_fraction_sql('t1', 't2')},
      hit AS (SELECT path, draw, arg_min(x, tryno) AS x, arg_min(y, tryno) AS y, arg_min(frac, tryno) AS frac FROM t2 WHERE frac >= 0.4 GROUP BY path, draw)"""


_RANDOM = f"""WITH {SLIDES}, {LEVELS}, {CELLS},
  d0 AS (SELECT path, width, height, mpp * ds AS mpp, trunc(256 * ds)::INT AS p, draw::INT AS draw FROM lv, range(100) r(draw) WHERE level = 0), {_attempt_sql('d0', 7, 50)},
  stop AS (SELECT path, min(draw) AS s FROM d0 LEFT JOIN hit USING (path, draw) WHERE x IS NULL GROUP BY path)
  SELECT path, draw, x, y, round(frac, 6) AS tissue_fraction FROM hit LEFT JOIN stop USING (path) WHERE s IS NULL OR draw < s"""


@query(_RANDOM)
def random_coords(spark, d):
    s = slides(spark, d)
    c = sampling.random_coords(s, masks(s), 100, seed=7)
    return c.select("path", "draw", "x", "y", F.round("tissue_fraction", 6).alias("tissue_fraction"))


_MULTI_PICK = f"CASE WHEN mpp IS NULL THEN NULL WHEN u < {0.4 / 1.0!r} THEN 0.25 WHEN u < {(0.4 + 0.3) / 1.0!r} THEN 0.5 WHEN u < {(0.4 + 0.3 + 0.2) / 1.0!r} THEN 1.0 ELSE 2.0 END::DOUBLE"
_LEVEL_DRAW = uniform_sql(9, 0, "path", "draw", "'level'")
_MULTI = f"""WITH {SLIDES}, {LEVELS}, {CELLS}, {_BEST},
  u AS (SELECT path, width, height, mpp, draw::INT AS draw, {_LEVEL_DRAW} AS u FROM sl, range(100) r(draw)),
  k AS (SELECT *, {_MULTI_PICK} AS target FROM u),
  d0 AS (SELECT k.path, k.draw, k.width, k.height, k.target, v.level, trunc(256 * v.ds)::INT AS p FROM k LEFT JOIN best b ON b.path = k.path AND b.target = k.target
    JOIN lv v ON v.path = k.path AND v.level = coalesce(b.level, 0)), {_attempt_sql('d0', 9, 50)}
  SELECT path, draw, x, y, level, target, round(frac, 6) AS tissue_fraction FROM hit JOIN d0 USING (path, draw)"""


@query(_MULTI)
def multi_magnification(spark, d):
    s = slides(spark, d)
    c = sampling.multi_magnification(s, masks(s), 100, weights=WEIGHTS, seed=9)
    return c.select("path", "draw", "x", "y", "level", "target", F.round("tissue_fraction", 6).alias("tissue_fraction"))


_CONT = f"""WITH {SLIDES}, {LEVELS}, {CELLS},
  u AS (SELECT path, width, height, mpp, draw::INT AS draw, 0.25::DOUBLE + 1.75::DOUBLE * {_LEVEL_DRAW.replace("'9'", "9")} AS t FROM sl, range(100) r(draw)),
  k AS (SELECT u.*, coalesce(max(v.level) FILTER (v.ds * u.mpp <= t), 0) AS level FROM u JOIN lv v USING (path) GROUP BY ALL),
  c AS (SELECT k.*, v.ds, CASE WHEN k.mpp IS NULL THEN 224 ELSE greatest(1, round_even(224 * t / (k.mpp * v.ds), 0)) END::INT AS crop FROM k JOIN lv v ON v.path = k.path AND v.level = k.level),
  d0 AS (SELECT path, draw, width, height, mpp, t, level, crop, CASE WHEN mpp IS NULL THEN floor(224 * ds) ELSE round_even(crop * ds, 0) END::INT AS p FROM c), {_attempt_sql('d0', 9, 50)}
  SELECT path, draw, x, y, level, crop AS patch_size, CASE WHEN mpp IS NOT NULL THEN round(t, 6) END AS mpp, round(frac, 6) AS tissue_fraction FROM hit JOIN d0 USING (path, draw)"""


@query(_CONT)
def continuous_magnification(spark, d):
    s = slides(spark, d)
    c = sampling.continuous(s, masks(s), 100, seed=9)
    return c.select(
        "path", "draw", "x", "y", "level", "patch_size", F.round("mpp", 6).alias("mpp"),
        F.round("tissue_fraction", 6).alias("tissue_fraction"),
    )


def _pool_sql(part: str = "path") -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {uniform_sql(3, 0, 'path', 'level', 'x', 'y')}, level, y, x) - 1"


@query(f"WITH {SLIDES}, {LEVELS}, {_grid_sql(4096, 4096)} SELECT path, x, y, {_pool_sql()} AS draw FROM (SELECT *, 0 AS level FROM grid)")
def pool_shuffle(spark, d):
    return sampling.pool(geometry.grid(slides(spark, d), 4096), 3).select("path", "x", "y", F.col("draw").cast("long").alias("draw"))


@query(
    f"WITH {SLIDES}, {LEVELS}, {_grid_sql(4096, 4096)} SELECT path, x, y, draw FROM (SELECT path, x, y, {_pool_sql()} AS draw FROM (SELECT *, 0 AS level FROM grid)) WHERE draw < 5"
)
def pool_truncate(spark, d):
    return sampling.pool(geometry.grid(slides(spark, d), 4096), 3, 5).select("path", "x", "y", F.col("draw").cast("long").alias("draw"))


_WEIGHTS = f"""{_BEST}, w AS (SELECT path, level, sum(CASE target WHEN 0.25 THEN 0.4 WHEN 0.5 THEN 0.3 WHEN 1.0 THEN 0.2 ELSE 0.1 END::DOUBLE) AS weight FROM best GROUP BY path, level)"""


@query(f"WITH {SLIDES}, {LEVELS}, {_WEIGHTS} SELECT path, level, round(weight, 9) AS weight FROM w")
def level_weights_merge(spark, d):
    return sampling.level_weights(slides(spark, d), TARGETS, WEIGHTS).withColumn("weight", F.round("weight", 9))


_RACE = f"""WITH {SLIDES}, {LEVELS}, {_WEIGHTS},
  g0 AS (SELECT path, width, height, level, weight, trunc(2048 * ds)::INT AS p FROM lv JOIN w USING (path, level)),
  g1 AS (SELECT *, unnest(range(0, height - p + 1, p))::INT AS y FROM g0 WHERE height >= p AND width >= p),
  g2 AS (SELECT *, unnest(range(0, width - p + 1, p))::INT AS x FROM g1),
  g3 AS (SELECT *, {_pool_sql('path, level')} AS k, -ln(1 - {uniform_sql(3, 0, 'path', 'level', 'x', 'y', "'wait'")}) / weight AS wait FROM g2),
  g4 AS (SELECT *, sum(wait) OVER (PARTITION BY path, level ORDER BY k) AS arrival FROM g3 WHERE k < 50),
  g5 AS (SELECT path, level, x, y, row_number() OVER (PARTITION BY path ORDER BY round(arrival, 9), level, k) - 1 AS draw FROM g4)
  SELECT path, level, x, y, draw FROM g5 WHERE draw < 50"""


@query(_RACE)
def multilevel_race(spark, d):
    p = sampling.multi_pool(slides(spark, d), TARGETS, WEIGHTS, 3, patch_size=2048, size=50)
    return p.select("path", "level", "x", "y", F.col("draw").cast("long").alias("draw"))


@query(
    f"WITH {SLIDES}, u AS (SELECT path, mpp, draw::INT AS draw, {_LEVEL_DRAW} AS u FROM sl, range(20) r(draw)) SELECT target, count(*) AS n FROM (SELECT {_MULTI_PICK} AS target FROM u WHERE mpp IS NOT NULL) GROUP BY 1"
)
def categorical_draw(spark, d):
    u = sampling.draws(slides(spark, d).filter("mpp is not null").select("path"), 20, 9)
    return u.groupBy(sampling.categorical(F.col("u_level"), TARGETS, WEIGHTS).alias("target")).agg(F.count("*").alias("n"))


def _cdf_sql(points: int, w: str) -> str:
    return f"""WITH g AS (SELECT i::INT AS i, 0.25::DOUBLE + i * (1.75::DOUBLE / {points - 1}) AS x FROM range({points}) r(i)), {w},
      p AS (SELECT i, x, w / sum(w) OVER () AS p FROM w) SELECT i, round(x, 9) AS x, round(p, 9) AS p, round(sum(p) OVER (ORDER BY i), 9) AS cdf FROM p"""


@query(
    _cdf_sql(
        1000,
        "k AS (SELECT *, x * (4 / 3::DOUBLE) - 0.015625::DOUBLE / (x * x * 3) - x * x / 2 AS k FROM g), w AS (SELECT i, x, exp(k - max(k) OVER ()) AS w FROM k)",
    )
)
def maxavg_weights(spark, d):
    return sampling.maxavg_weights(spark).select("i", *[F.round(c, 9).alias(c) for c in ("x", "p", "cdf")])


@query(_cdf_sql(100, """k AS (SELECT i, x, 1 / (1 + (lag(x) OVER (ORDER BY i) / x) ** 2) AS l, 1 / (1 + (x / lead(x) OVER (ORDER BY i)) ** 2) AS r FROM g),
  w AS (SELECT i, x, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE l + r - 1 END AS w FROM k)"""))
def minmax_weights(spark, d):
    return sampling.minmax_weights(spark).select("i", *[F.round(c, 9).alias(c) for c in ("x", "p", "cdf")])


@query(
    f"SELECT slide_path, cancer_type FROM (SELECT *, row_number() OVER (PARTITION BY cancer_type ORDER BY {uniform_sql(5, 'slide_path')}, slide_path) AS r FROM (SELECT DISTINCT slide_path, cancer_type FROM slide_metadata)) WHERE r <= 10"
)
def stratified_sample(spark, d):
    m = table(spark, d, "slide_metadata").select("slide_path", "cancer_type").distinct()
    return sampling.stratified(m, F.col("cancer_type"), 10, uniform(5, "slide_path"), "slide_path")


# -- schedule ----------------------------------------------------------------


@query(
    f"WITH {_ORDERED}, w AS (SELECT i AS pos, draw::INT AS draw FROM o, range(12) r(draw)) SELECT pos, draw, row_number() OVER (ORDER BY pos // 8, draw // 3, pos % 8, draw % 3) - 1 AS seq FROM w"
)
def interleave_order(spark, d):
    pos = grouped_prefix_sum(cut(slides(spark, d).select("path", F.lit(1).alias("one"))), [], ["path"], "one", before="pos")
    draws = pos.select("pos", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("draw"))
    return schedule.interleave(draws, 8, 3).select("pos", "draw", "seq")


# The queue of 8 desks, slide by slide; then every draw's place.
_VISITS = f"""WITH RECURSIVE {_ORDERED}, z AS (SELECT i AS pos, {bits_sql('path')} % 7 + 1 AS n FROM o),
  q AS (SELECT pos, n // 2 AS more FROM z),
  sim AS (SELECT 0::BIGINT AS pos, 0::BIGINT AS lap, [{{'e': more, 'p': pos}}] AS ends FROM q WHERE pos = 0
    UNION ALL SELECT q.pos, CASE WHEN len(ends) < 8 THEN 0 ELSE list_min(ends).e END,
      list_append(CASE WHEN len(ends) < 8 THEN ends ELSE list_filter(ends, lambda x: x <> list_min(ends)) END,
        {{'e': CASE WHEN len(ends) < 8 THEN 0 ELSE list_min(ends).e END + q.more, 'p': q.pos}}) FROM sim JOIN q ON q.pos = sim.pos + 1)
  SELECT pos, draw, row_number() OVER (ORDER BY lap + draw // 2, pos, draw) - 1 AS seq
  FROM (SELECT pos, lap, unnest(range(0, n))::INT AS draw FROM sim JOIN z USING (pos))"""


@query(_VISITS)
def interleave_visits(spark, d):
    """Slides of unequal length."""
    pos = grouped_prefix_sum(cut(slides(spark, d).select("path", F.lit(1).alias("one"))), [], ["path"], "one", before="pos")
    draws = pos.select("pos", F.explode(F.sequence(F.lit(0), (bits("path") % 7).cast("int"))).alias("draw"))
    return schedule.interleave_unequal(draws, 8, 2).select("pos", "draw", "seq")


_DRAWS = "once AS (SELECT slide_path, draw, max(epoch) AS epoch FROM patches GROUP BY 1, 2)"


@query(
    f"WITH {_DRAWS}, k AS (SELECT slide_path, draw, row_number() OVER (PARTITION BY slide_path ORDER BY draw) - 1 AS i FROM once) SELECT slide_path, count(*) AS n, max(draw) AS last_draw FROM k WHERE i < 100 GROUP BY 1"
)
def budget_filter(spark, d):
    once = table(spark, d, "patches").select("slide_path", "draw").distinct().withColumn("one", F.lit(1))
    k = grouped_prefix_sum(
        cut(once), ["slide_path"], ["draw"], "one", before="i",
    ).withColumnRenamed("draw", "id").withColumnRenamed("i", "draw")
    return schedule.budget(k, 100).groupBy("slide_path").agg(F.count("*").alias("n"), F.max("id").alias("last_draw"))


@query(
    f"WITH {SLIDES}, {LEVELS}, {_grid_sql(16384, 16384)}, z AS (SELECT path, count(*) AS n FROM grid GROUP BY path) SELECT path, k::INT AS k, (k // n)::BIGINT AS pass, (k % n)::BIGINT AS place FROM z, range(20) r(k)"
)
def without_replacement_cycle(spark, d):
    sizes = geometry.grid(slides(spark, d), 16384).groupBy("path").agg(F.count("*").alias("n"))
    return schedule.without_replacement(sizes, 20).select("path", "k", "pass", "place")


@query(
    f"WITH {SLIDES} SELECT epoch::INT AS epoch, path, row_number() OVER (PARTITION BY epoch ORDER BY {uniform_sql(11, 'epoch', 'path')}, path) - 1 AS pos FROM sl, range(3) r(epoch)"
)
def slide_cycle(spark, d):
    s = schedule.cycle(slides(spark, d).select("path"), 3).withColumn("u", uniform(11, "epoch", "path")).withColumn("one", F.lit(1))
    return grouped_prefix_sum(cut(s), ["epoch"], ["u", "path"], "one", before="pos").select("epoch", "path", "pos")


@query("""WITH f AS (SELECT slide_path AS path FROM patches GROUP BY 1 HAVING count(*) = count(*) FILTER (tissue_fraction IS NULL OR isnan(tissue_fraction) OR tissue_fraction NOT BETWEEN 0.5 AND 1))
  SELECT DISTINCT path FROM slides WHERE path NOT IN (SELECT path FROM f WHERE path IS NOT NULL) AND path IS NOT NULL""")
def blacklist_anti(spark, d):
    ok = F.coalesce((F.col("tissue_fraction") >= 0.5) & (F.col("tissue_fraction") <= 1), F.lit(False))
    f = table(spark, d, "patches").groupBy(F.col("slide_path").alias("path")).agg(
        F.count("*").alias("reads"), F.sum((~ok).cast("int")).alias("failed"),
    )
    return schedule.blacklist(slides(spark, d).select("path"), f)


_LRU = """WITH u AS (SELECT event_id, user_id % 4 AS worker, user_id % 64 AS k, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i FROM events),
  p AS (SELECT *, lag(i) OVER (PARTITION BY worker, k ORDER BY i) AS prev FROM u),
  s AS (SELECT a.event_id, count(DISTINCT b.k) AS since FROM p a JOIN p b ON a.worker = b.worker AND b.i > a.prev AND b.i < a.i GROUP BY 1)
  SELECT event_id, (prev IS NOT NULL AND coalesce(since, 0) < 8) AS hit FROM p LEFT JOIN s USING (event_id)"""


@query(_LRU)
def lru_hits(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("worker"), (F.col("user_id") % 64).alias("k"))
    return schedule.lru_hits(e, "worker", "k", ["ts", "event_id"], 8).select("event_id", "hit")


# -- metadata ----------------------------------------------------------------

_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
_PARTS = f"""{SLIDES}, st AS (SELECT path, {_STEM} AS stem, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS folder FROM sl),
  pt AS (SELECT path, stem, folder, regexp_matches(stem, '{metadata.BARCODE}') AS ok, {', '.join(f"nullif(regexp_extract(stem, '{metadata.BARCODE}', {i}), '') AS p{i}" for i in range(1, 7))} FROM st),
  codes AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in metadata.SAMPLE_TYPES.items())}) t(code, kind)),
  meta AS (SELECT path, 'TCGA' AS dataset_name, 'TCGA-' || p1 || '-' || p2 AS patient_id, p1 AS tissue_type, CASE WHEN ok AND folder LIKE 'TCGA-%' THEN folder END AS cancer_type,
    CASE WHEN ok THEN coalesce(kind, 'Unknown (' || p3 || ')') END AS sample_type, p4 AS vial, p5 AS portion, p6 AS slide_id, substr(p6, 1, 2) AS slide_section, CASE WHEN ok THEN substr(p6, 1, 2) IN ('TS', 'BS', 'MS') END AS is_frozen,
    p3 AS sample_code, 'TCGA-' || p1 || '-' || p2 || '-' || p3 || p4 || '-' || p5 || '-' || p6 AS barcode, CASE WHEN NOT ok THEN 'Could not parse barcode from: ' || stem END AS parse_error
    FROM pt LEFT JOIN codes ON code = p3)"""


@query(
    f"WITH {_PARTS} SELECT path, patient_id, tissue_type, cancer_type, sample_type, vial, portion, slide_id, is_frozen, barcode, parse_error FROM meta"
)
def tcga_barcode(spark, d):
    m = metadata.parse_barcode(slides(spark, d).select("path"))
    return m.select(
        "path", "patient_id", "tissue_type", "cancer_type", "sample_type", "vial", "portion", "slide_id", "is_frozen", "barcode",
        "parse_error",
    )


@query(f"WITH {_PARTS} SELECT sample_type, is_frozen, count(*) AS n FROM meta GROUP BY 1, 2")
def sample_type_join(spark, d):
    return metadata.parse_barcode(slides(spark, d).select("path")).groupBy("sample_type", "is_frozen").agg(F.count("*").alias("n"))


@query(f"""WITH {_PARTS} SELECT path, dataset_name, coalesce(patient_id, '') AS patient_id, coalesce(tissue_type, '') AS tissue_type, coalesce(cancer_type, '') AS cancer_type, coalesce(sample_type, '') AS sample_type,
  CASE WHEN parse_error IS NULL THEN '{{"tissue_source_site":"' || tissue_type || '","vial":"' || vial || '","portion":"' || portion || '","slide_id":"' || slide_id || '","slide_section":"' || slide_section
    || '","is_frozen":' || is_frozen || ',"sample_code":"' || sample_code || '","barcode":"' || barcode || '"}}' ELSE '{{"parse_error":"' || parse_error || '"}}' END AS extra FROM meta""")
def flat_metadata(spark, d):
    return metadata.flat(metadata.parse_barcode(slides(spark, d).select("path")), metadata.EXTRA)


@query("SELECT file_id AS id, filename, md5sum AS md5, file_size AS size, state FROM manifest")
def manifest_tsv(spark, d):
    return metadata.manifest_rows(table(spark, d, "manifest"))


@query(
    "SELECT cancer_type, count(*) AS n, round(coalesce(sum(file_size), 0) / (1024.0 ** 3), 6) AS gb, grouping(cancer_type)::INT AS is_total FROM manifest GROUP BY ROLLUP (cancer_type)"
)
def manifest_rollup(spark, d):
    return metadata.summary(table(spark, d, "manifest")).withColumn("gb", F.round("gb", 6))


_LIST = f"SELECT '/out/' || cancer_type || '/' || filename AS dest, file_size + ({bits_sql('file_id')} % 6 = 0)::INT AS size FROM manifest WHERE {bits_sql('file_id')} % 3 = 0"


@query(
    f"WITH l AS ({_LIST}), m AS (SELECT DISTINCT '/out/' || cancer_type || '/' || filename AS dest, file_size FROM manifest WHERE cancer_type IS NOT NULL AND filename IS NOT NULL) SELECT DISTINCT dest FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.dest = m.dest AND l.size IS NOT DISTINCT FROM m.file_size)"
)
def skip_existing_anti(spark, d):
    m = table(spark, d, "manifest").filter("cancer_type is not null and filename is not null")
    l = m.filter(bits("file_id") % 3 == 0).select(
        metadata.destination("/out").alias("dest"), (F.col("file_size") + (bits("file_id") % 6 == 0).cast("int")).alias("size"),
    )  # noqa: E741
    return metadata.missing(m, l, "/out").select("dest")


@query("""SELECT s_suppkey AS file_id, s_name AS filename, n_name AS cancer_type FROM (SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0
  UNION ALL SELECT s_suppkey::VARCHAR, s_name, 'unknown' FROM supplier WHERE s_suppkey % 5 = 0)""")
def gdc_hits(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    case = F.struct(F.struct(F.col("n_name").alias("project_id")).alias("project"))
    nested = s.select(
        F.col("s_suppkey").cast("string").alias("file_id"), F.col("s_name").alias("file_name"), F.lit(1).cast("long").alias("file_size"),
        F.lit("").alias("md5sum"), F.lit("released").alias("state"),
        F.when(F.col("s_suppkey") % 5 != 0, F.array(case)).otherwise(F.slice(F.array(case), 2, 1)).alias("cases"),
    )
    return metadata.hits(nested).select("file_id", "filename", "cancer_type")


# -- statistics --------------------------------------------------------------


@query("SELECT round(mpp, 2) AS mpp, count(*) AS n FROM patches GROUP BY 1")
def mpp_histogram(spark, d):
    return geometry.magnification_histogram(table(spark, d, "patches").select("mpp"))


@query(f"""WITH {_PARTS}, {CELLS}, fr AS (SELECT path, avg(tissue::INT) AS f FROM cells GROUP BY path), op AS (SELECT meta.*, f FROM meta JOIN fr USING (path))
  SELECT 'pipeline/' || key AS key, round(value, 6) AS value FROM (
    SELECT unnest([{{'key': 'slides_processed', 'value': count(*)::DOUBLE}}, {{'key': 'slides_unique', 'value': count(DISTINCT path)}}, {{'key': 'min_tissue_fraction', 'value': min(f)}}, {{'key': 'max_tissue_fraction', 'value': max(f)}}, {{'key': 'mean_tissue_fraction', 'value': avg(f)}}], recursive := true) FROM op
    UNION ALL SELECT 'patches_extracted', count(*) FROM patches WHERE tissue_fraction >= 0.2 AND NOT isnan(tissue_fraction)
    UNION ALL SELECT 'patches_filtered', count(*) FROM patches WHERE tissue_fraction IS NULL OR isnan(tissue_fraction) OR tissue_fraction < 0.2
    UNION ALL SELECT 'slides_failed', count(*) FROM sl WHERE vendor IS NULL
    UNION ALL SELECT CASE WHEN mpp IS NULL THEN 'mpp_unknown' ELSE 'mpp_' || format('{{:.2f}}', round(mpp, 2)) END, count(*) FROM patches WHERE tissue_fraction >= 0.2 AND NOT isnan(tissue_fraction) GROUP BY 1
    UNION ALL SELECT 'cancer_type/' || cancer_type, count(*) FROM op WHERE cancer_type <> '' GROUP BY 1
    UNION ALL SELECT 'sample_type/' || replace(lower(sample_type), ' ', '_'), count(*) FROM op WHERE sample_type <> '' GROUP BY 1
    UNION ALL SELECT 'error_count', count(*) FROM events WHERE event_type = 'error' HAVING count(*) > 0)""")
def pipeline_stats(spark, d):
    s = slides(spark, d)
    opened = metadata.parse_barcode(tissue.slide_fraction(mask_cells(s)).select("path", "tissue_fraction"))
    patches = table(spark, d, "patches").select("mpp", "tissue_fraction")
    kept = F.coalesce((F.col("tissue_fraction") >= 0.2) & ~F.isnan("tissue_fraction"), F.lit(False))
    errors = table(spark, d, "events").filter("event_type = 'error'")
    return stats.pipeline_stats(
        opened, patches.filter(kept), errors, failed=s.filter("vendor is null"), filtered=patches.filter(~kept),
    ).withColumn("value", F.round("value", 6))


@query(
    "SELECT event_id, value, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100"
)
def recent_errors(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "value")
    return stats.recent_errors(e, "event_id")


_STEPS = "st AS (SELECT event_id AS step, (value * 1000000)::BIGINT AS wait, (value * 500000)::BIGINT AS compute, (value * 2000000)::BIGINT AS wall, 64 AS patches FROM events)"


def _metric_sql(keys: str) -> str:
    return f"""WITH {_STEPS}, a AS (SELECT {keys} count(*) AS steps, sum(wait)::DOUBLE AS w, sum(compute)::DOUBLE AS c, sum(wall)::DOUBLE AS l, sum(patches)::DOUBLE AS p FROM st {'GROUP BY 1' if keys else ''})
      SELECT {keys.split(' AS ')[-1] if keys else ''} steps, round(w / 1e6 / steps, 6) AS data_wait_ms, round(c / 1e6 / steps, 6) AS compute_ms, round(l / 1e6 / steps, 6) AS step_ms, round(w / greatest(l, 1), 6) AS data_fraction,
        round(steps / greatest(l / 1e9, 1e-9), 6) AS batches_per_sec, round(p / greatest(l / 1e9, 1e-9), 6) AS patches_per_sec FROM a"""


def _steps(spark, d):
    v = F.col("value")
    ns = lambda k, c: F.round(v * k).cast("long").alias(c)
    return table(spark, d, "events").select(
        F.col("event_id").alias("step"), ns(1000000, "data_wait_ns"), ns(500000, "compute_ns"), ns(2000000, "wall_ns"),
        F.lit(64).alias("patches"),
    )


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[c if c in keep else F.round(c, 6).alias(c) for c in df.columns])


@query(_metric_sql("(step // 50)::BIGINT AS window,").replace("AS window", 'AS "window"').replace("SELECT window", 'SELECT "window"'))
def loader_metrics(spark, d):
    return _rounded(stats.loader_metrics(_steps(spark, d), 50), "window", "steps")


@query(_metric_sql(""))
def loader_lifetime(spark, d):
    return _rounded(stats.lifetime_metrics(_steps(spark, d)), "steps")


_BENCH = """WITH b AS (SELECT event_type AS config, user_id % 4 AS rank, value AS ms FROM events),
  r AS (SELECT config, rank, count(*) * 64 AS p, sum(ms) / 1000 AS s, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95 FROM b GROUP BY 1, 2),
  q AS (SELECT *, p / greatest(s, 1e-9) AS r FROM r), a AS (
  SELECT config, count(*) AS world_size, round(min(r) * count(*), 6) AS effective, round(sum(r), 6) AS aggregate, round(max(s), 6) AS total_sec, round(max(p50), 6) AS batch_p50_ms, round(max(p95), 6) AS batch_p95_ms FROM q GROUP BY 1)"""


def _bench(spark, d):
    b = table(spark, d, "events").select(
        F.col("event_type").alias("config"), (F.col("user_id") % 4).alias("rank"), F.col("value").alias("batch_ms"),
        F.lit(64).alias("patches"),
    )
    s = stats.benchmark_summary(b, ["config"])
    return s.select(
        "config", "world_size", *[F.round(c, 6).alias(c) for c in ("effective", "aggregate", "total_sec", "batch_p50_ms", "batch_p95_ms")],
    )


@query(f"{_BENCH} SELECT * FROM a")
def benchmark_summary(spark, d):
    return _bench(spark, d)


@query(f"{_BENCH} SELECT config, effective FROM a ORDER BY effective DESC, config LIMIT 1")
def benchmark_best(spark, d):
    return stats.best(_bench(spark, d).select("config", "effective"))


@query(
    "SELECT w AS num_workers, p AS pool_size, s AS per_slide, v AS per_visit FROM (SELECT unnest([1, 2, 4]) AS w), (SELECT unnest([4, 8]) AS p), (SELECT 100 AS s), (SELECT unnest([1, 4]) AS v) WHERE (SELECT count(DISTINCT path) FROM slides) >= 4"
)
def config_sweep(spark, d):
    n = slides(spark, d).select("path").distinct().count()
    rows = stats.sweep(n, 4, num_workers=[1, 2, 4], pool_size=[4, 8], per_slide=100, per_visit=[1, 4])
    return spark.createDataFrame([tuple(r.values()) for r in rows], "num_workers int, pool_size int, per_slide int, per_visit int")


# -- pixels ------------------------------------------------------------------

_BOX = "h BETWEEN 90 AND 180 AND s BETWEEN 8 AND 255 AND v BETWEEN 103 AND 255"


def _hsv(spark, d):
    p = pixels(spark, d)
    h, s, v = px.hsv(F.col("red"), F.col("green"), F.col("blue"))
    return p.withColumns({"h": h, "s": s, "v": v})


@query(f"WITH {PIXELS}, {HSV} SELECT img_id, i, h::INT AS h, s::INT AS s, v::INT AS v FROM hsv")
def hsv_pixels(spark, d):
    return _hsv(spark, d).select("img_id", "i", "h", "s", "v")


@query(
    f"WITH {PIXELS}, {HSV} SELECT img_id, round(avg(({_BOX})::INT), 6) AS fraction, avg(({_BOX})::INT) >= 0.5 AS accepted FROM hsv GROUP BY img_id"
)
def hsv_filter(spark, d):
    ok = F.avg(px.inside(F.col("h"), F.col("s"), F.col("v")).cast("int"))
    return _hsv(spark, d).groupBy("img_id").agg(F.round(ok, 6).alias("fraction"), (ok >= 0.5).alias("accepted"))


_GRAY = "floor(red * 0.299::DOUBLE + green * 0.587::DOUBLE + blue * 0.114::DOUBLE + 0.5)::INT"


@query(f"""WITH {PIXELS}, hi AS (SELECT img_id, {_GRAY} AS gray, count(*) AS n FROM px GROUP BY 1, 2),
  a AS (SELECT *, sum(n) OVER w AS n0, sum(n * gray) OVER w AS s0, sum(n) OVER g AS nn, sum(n * gray) OVER g AS ss FROM hi WINDOW w AS (PARTITION BY img_id ORDER BY gray), g AS (PARTITION BY img_id)),
  v AS (SELECT img_id, gray, CASE WHEN n0 < nn THEN (s0 * nn - ss * n0)::DOUBLE * (s0 * nn - ss * n0)::DOUBLE / (n0 * (nn - n0))::DOUBLE END AS v FROM a)
  SELECT img_id, arg_min(gray, (-v, gray)) FILTER (v IS NOT NULL) AS threshold FROM v GROUP BY img_id""")
def gray_otsu(spark, d):
    h = pixels(spark, d).groupBy("img_id", px.gray(F.col("red"), F.col("green"), F.col("blue")).alias("gray")).agg(F.count("*").alias("n"))
    return tissue.otsu_threshold(h, ["img_id"])


@query(
    f"WITH {PIXELS} SELECT img_id, i, round((red / 255::DOUBLE - 0.5) / 0.25, 6) AS red, round((green / 255::DOUBLE - 0.4) / 0.2, 6) AS green, round((blue / 255::DOUBLE - 0.3) / 0.1, 6) AS blue FROM px"
)
def normalize(spark, d):
    n = {"red": (0.5, 0.25), "green": (0.4, 0.2), "blue": (0.3, 0.1)}
    return pixels(spark, d).select("img_id", "i", *[F.round(px.normalised(F.col(c), *v), 6).alias(c) for c, v in n.items()])


_U = {c: f"(2 * {uniform_sql(13, 'img_id', repr(c))} - 1)" for c in ("a0", "b0", "a1", "b1", "a2", "b2")}
_OD = {c: f"(-ln({c} / 255::DOUBLE + 1e-6))" for c in ("red", "green", "blue")}


def _dot(cols: list[str], m, j: int) -> str:
    return " + ".join(f"{c} * ({float(m[i][j])!r}::DOUBLE)" for i, c in enumerate(cols))


@query(f"""WITH {PIXELS}, u AS (SELECT vec_id AS img_id, {', '.join(f'{v.replace("img_id", "vec_id")} AS {k}' for k, v in _U.items())} FROM embeddings),
  c AS (SELECT px.img_id, i, {', '.join(f'({_dot(list(_OD.values()), images.UNSTAIN, j)}) * (1 + a{j} * 0.05) + b{j} * 0.05 AS c{j}' for j in range(3))} FROM px JOIN u USING (img_id))
  SELECT img_id, {', '.join(f'round(avg((exp(-({_dot(["c0", "c1", "c2"], images.STAINS, j)})) - 1e-6) * 255), 4) AS {n}' for j, n in enumerate(('red', 'green', 'blue')))} FROM c GROUP BY img_id""")
def hed_perturb(spark, d):
    """Means of the perturbed channels before clipping."""
    u = lambda c: F.lit(2.0) * uniform(13, "img_id", F.lit(c)) - 1
    od = [-F.log(F.col(c) / F.lit(255.0) + F.lit(1e-6)) for c in ("red", "green", "blue")]
    dot = lambda cols, m, j: sum((c * F.lit(float(m[i][j])) for i, c in enumerate(cols)), F.lit(0.0))
    p = pixels(spark, d)
    c = p.select("img_id", *[(dot(od, images.UNSTAIN, j) * (1 + u(f"a{j}") * 0.05) + u(f"b{j}") * 0.05).alias(f"c{j}") for j in range(3)])
    back = [(F.exp(-dot([F.col("c0"), F.col("c1"), F.col("c2")], images.STAINS, j)) - F.lit(1e-6)) * 255 for j in range(3)]
    return c.groupBy("img_id").agg(*[F.round(F.avg(b), 4).alias(n) for b, n in zip(back, ("red", "green", "blue"), strict=True)])


_FLIP = f"""f AS (SELECT vec_id AS img_id, {bits_sql(17, 'vec_id')} % 2 = 1 AS fh, {bits_sql(18, 'vec_id')} % 2 = 1 AS fv, CASE WHEN {bits_sql(19, 'vec_id')} % 2 = 1 THEN 1 + {bits_sql(20, 'vec_id')} % 3 ELSE 0 END AS k FROM embeddings)"""


@query(f"""WITH {PIXELS}, {_FLIP}, a AS (SELECT img_id, CASE WHEN fv THEN 7 - i // 8 ELSE i // 8 END AS r, CASE WHEN fh THEN 7 - i % 8 ELSE i % 8 END AS c, k, red FROM px JOIN f USING (img_id))
  SELECT img_id, CASE k WHEN 0 THEN r * 8 + c WHEN 1 THEN (7 - c) * 8 + r WHEN 2 THEN (7 - r) * 8 + 7 - c ELSE c * 8 + 7 - r END::INT AS i, red FROM a""")
def flip_rotate(spark, d):
    """Mirrored and turned by an index map; a quarter turn is counter-clockwise."""
    p = pixels(spark, d)
    odd = lambda s: bits(s, "img_id") % 2 == 1
    r0, c0 = F.floor(F.col("i") / 8), F.col("i") % 8
    a = p.select(
        "img_id", "red", F.when(odd(18), 7 - r0).otherwise(r0).alias("r"), F.when(odd(17), 7 - c0).otherwise(c0).alias("c"),
        F.when(odd(19), 1 + bits(20, "img_id") % 3).otherwise(0).alias("k"),
    )
    r, c, k = F.col("r"), F.col("c"), F.col("k")
    at = F.when(k == 0, r * 8 + c).when(k == 1, (7 - c) * 8 + r).when(k == 2, (7 - r) * 8 + 7 - c).otherwise(c * 8 + 7 - r)
    return a.select("img_id", at.cast("int").alias("i"), "red")


_CROP_T = f"""t AS (SELECT path, tryno, 512 * 512 * (0.08::DOUBLE + 0.92::DOUBLE * {uniform_sql(23, 'path', 'tryno', "'area'")}) AS area,
  exp(ln(0.75::DOUBLE) + (ln(4 / 3::DOUBLE) - ln(0.75::DOUBLE)) * {uniform_sql(23, 'path', 'tryno', "'ratio'")}) AS ratio FROM sl, (SELECT tryno::INT AS tryno FROM range(10) r(tryno)))"""


@query(f"""WITH {SLIDES}, {_CROP_T}, z AS (SELECT path, tryno, round_even(sqrt(area * ratio), 0)::INT AS w, round_even(sqrt(area / ratio), 0)::INT AS h FROM t),
  b AS (SELECT path, arg_min(w, tryno) AS w, arg_min(h, tryno) AS h FROM z WHERE w BETWEEN 1 AND 512 AND h BETWEEN 1 AND 512 GROUP BY path)
  SELECT path, coalesce(w, 512) AS w, coalesce(h, 512) AS h, least(floor({uniform_sql(23, 'path', "'x'")} * (512 - coalesce(w, 512) + 1)), 512 - coalesce(w, 512))::INT AS x,
    least(floor({uniform_sql(23, 'path', "'y'")} * (512 - coalesce(h, 512) + 1)), 512 - coalesce(h, 512))::INT AS y FROM sl LEFT JOIN b USING (path)""")
def crop_params(spark, d):
    """Random crops of a 512 x 512 patch: the first of ten tries that fits, else the whole."""
    s = slides(spark, d).select("path")
    tries = F.sequence(F.lit(0), F.lit(9))
    import math

    low, high = math.log(0.75), math.log(4 / 3)

    def one(t):
        area = F.lit(512.0 * 512) * (F.lit(0.08) + F.lit(0.92) * uniform(23, "path", t, F.lit("area")))
        ratio = F.exp(F.lit(low) + F.lit(high - low) * uniform(23, "path", t, F.lit("ratio")))
        return F.struct(F.rint(F.sqrt(area * ratio)).cast("int").alias("w"), F.rint(F.sqrt(area / ratio)).cast("int").alias("h"))

    fit = F.get(F.filter(F.transform(tries, one), lambda b: b["w"].between(1, 512) & b["h"].between(1, 512)), F.lit(0))
    c = s.select("path", F.coalesce(fit["w"], F.lit(512)).alias("w"), F.coalesce(fit["h"], F.lit(512)).alias("h"))
    at = lambda lane, side: F.least(F.floor(uniform(23, "path", F.lit(lane)) * (512 - F.col(side) + 1)), 512 - F.col(side)).cast("int")
    return c.withColumn("x", at("x", "w")).withColumn("y", at("y", "h"))


@query(
    "SELECT name, CASE WHEN count = 1 THEN name ELSE name || '_' || i END AS view FROM (SELECT 'global' AS name, 2 AS count UNION ALL SELECT 'local', 8 UNION ALL SELECT 'context', 1), range(8) r(i) WHERE i < count"
)
def view_names(spark, d):
    from .operators.views import View, names_of

    given = [View("global", count=2), View("local", count=8), View("context", mpp=2.0)]
    names_of(given)
    return spark.createDataFrame([(v.name, n) for v in given for n in v.names()], "name string, view string")


@query(f"""WITH {SLIDES}, {LEVELS}, p AS (SELECT DISTINCT slide_path AS path, draw, x, y, level, patch_size FROM patches),
  v AS (SELECT path, coalesce(CASE WHEN any_value(mpp) IS NULL THEN 0 END, arg_min(level, (abs(mpp * ds - 2.0), level))) AS vl FROM lv GROUP BY path)
  SELECT p.path, draw, p.level, vl AS view_level, round_even(x + patch_size * a.ds / 2 - patch_size * b.ds / 2, 0)::BIGINT AS vx, round_even(y + patch_size * a.ds / 2 - patch_size * b.ds / 2, 0)::BIGINT AS vy
  FROM p JOIN v USING (path) JOIN lv a ON a.path = p.path AND a.level = p.level JOIN lv b ON b.path = p.path AND b.level = vl""")
def view_center(spark, d):
    p = table(spark, d, "patches").select(F.col("slide_path").alias("path"), "draw", "x", "y", "level", "patch_size").distinct()
    j = p.join(slides(spark, d).select("path", "mpp", "levels"), "path").withColumn("view_level", geometry.best_level(2.0))
    j = j.withColumn("a", geometry.downsample_of(F.col("level"))).withColumn(
        "b", geometry.downsample_of(F.col("view_level")),
    ).filter("a is not null")
    vx, vy = geometry.view_centre(F.col("x"), F.col("y"), F.col("a"), F.col("patch_size"), F.col("b"))
    return j.select("path", "draw", "level", "view_level", vx.alias("vx"), vy.alias("vy"))


@query(
    f"WITH {PIXELS}, v AS (SELECT img_id, i, 0 AS c, red AS x FROM px UNION ALL SELECT img_id, i, 1, green FROM px UNION ALL SELECT img_id, i, 2, blue FROM px) SELECT img_id, string_agg(x::VARCHAR, ',' ORDER BY c, i) AS image FROM v GROUP BY img_id"
)
def chw_collate(spark, d):
    """Inside each row: images are never taken apart and put together again."""
    pixel = lambda p: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*[F.get(p, (i + k) % 64) for k in (0, 21, 42)]))
    hwc = px.once(plane(), lambda p: F.flatten(pixel(p)))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("img_id"), F.concat_ws(",", px.chw(hwc, 8, 8).cast("array<string>")).alias("image"),
    )


@query()
def synthetic_patches(spark, d):
    """Patches of 256 px, 100 of each slide, read, filtered and transformed in one pass; pixels have no SQL.

    A row for each patch that passes the filter, with a hash of all its pixels.
    """
    from .plans.pipeline import Pipeline
    from .sources.readers import Stained

    s = slides(spark, d)
    p = Pipeline(s, masks(s), seed=1).grid(256, shuffle=True).schedule(per_slide=100).read(Stained).filter(images.HsvFilter())
    return p.transform(images.FlipRotate(), images.HedJitter()).patches().select(
        "path", "draw", "x", "y", "level", "patch_size", "mpp", "tissue_fraction", F.length("image.data").alias("n_bytes"),
        F.col("image.dtype").alias("dtype"), F.xxhash64("image.data").alias("pixels"),
    )
