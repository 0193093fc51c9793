"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import bits_sql
from ..materialize import cut
from ..skew import join_one
from .balance import BalancedSample, key_of, project_key
from .leakage import find_leaks
from .mixing import Mix
from .percentiles import combine, percentiles, summarise
from .spans import SharedSpans
from .splits import grouped_split, related
from .topn import top_n

POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]

# Words in the shape of a shortened patient id that name nobody.
FILLERS = ["NO-NAME", "NO-DATA"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def best_patches(spark: SparkSession, d: str) -> DataFrame:
    return top_n(_table(spark, d, "patches"), "slide_path", "tissue_fraction", "draw", 5, low=0.0, high=1.0)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return best_patches(spark, d).select("slide_path", "draw")


def fraction_summary(spark: SparkSession, d: str) -> DataFrame:
    """Valid tissue fractions, each draw once, by day of extraction, cancer type and mpp of two decimals."""
    p = _table(spark, d, "patches").select("slide_path", "draw", "tissue_fraction", "mpp", F.to_date("extracted_at").alias("day"))
    p = p.filter((F.col("tissue_fraction") >= 0) & (F.col("tissue_fraction") <= 1))
    once = p.groupBy("slide_path", "draw").agg(
        F.max("tissue_fraction").alias("value"), F.max("mpp").alias("mpp"), F.min("day").alias("day"),
    )
    mpp = F.when(F.col("mpp") > 0, F.round("mpp", 2))
    part = once.groupBy("slide_path", "day", mpp.alias("mpp"), "value").agg(F.count("*").alias("n"))
    m = _table(spark, d, "slide_metadata").filter(F.col("slide_path").isNotNull())
    cancer = m.groupBy("slide_path").agg(F.max(F.upper(F.regexp_replace(project_key(F.col("cancer_type")), " ", "-"))).alias("cancer_type"))
    return summarise(part.join(cancer, "slide_path", "left"), ["day", "cancer_type", "mpp"], "value", weight="n")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Over all days, from the summaries of the days."""
    group = ["cancer_type", "mpp"]
    found = percentiles(combine(fraction_summary(spark, d), group), group, POINTS)
    return found.select(*group, "n_values", "p", F.round("percentile", 9).alias("percentile"))


def p2_days(spark: SparkSession, d: str) -> DataFrame:
    """Medians of each day."""
    group = ["day", "cancer_type", "mpp"]
    found = percentiles(fraction_summary(spark, d), group, [0.5])
    return found.select(*group, "n_values", F.round("percentile", 9).alias("median"))


def patients(value: Column, fillers: list[str] = FILLERS) -> Column:
    """The patients a text names, each as ``SS-PPPP`` (site and participant).

    Letter case and the kind of separator do not matter; the project prefix may be
    missing and sample, portion and slide codes may follow.  Ids of one repeated
    character (``00-0000``, ``XX-XXXX``) are fillers and name nobody.
    """
    one = F.regexp_replace(F.upper(value), "[^A-Z0-9]+", "-")
    found = F.regexp_extract_all(one, F.lit(r"(?<![A-Z0-9])(?:TCGA-)?([A-Z0-9]{2}-(?!TCGA(?![A-Z0-9]))[A-Z0-9]{4})(?![A-Z0-9])"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda x: _real(x, fillers))


def patient_of_path(path: Column, fillers: list[str] = FILLERS) -> Column:
    """The patient whose barcode opens the file name, as a list of one or none."""
    name = F.upper(F.regexp_extract(path, r"([^/\\]*)$", 1))
    found = F.regexp_extract(name, r"^TCGA-([A-Z0-9]{2}-[A-Z0-9]{4})(?![A-Z0-9])", 1)
    return F.filter(F.array(found), lambda x: (x != "") & _real(x, fillers))


def _real(x: Column, fillers: list[str]) -> Column:
    return ~x.rlike(r"^(.)\1-\1{4}$") & ~x.isin(fillers)


def slide_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All slides; which patients each names; and the metadata."""
    m = _table(spark, d, "slide_metadata").filter(F.col("slide_path").isNotNull())
    paths = m.select("slide_path").unionByName(
        _table(spark, d, "patches").select("slide_path").filter(F.col("slide_path").isNotNull())
    ).distinct()
    given = m.select("slide_path", F.explode(patients(F.col("patient_id"))).alias("patient"))
    opened = paths.select("slide_path", F.explode(patient_of_path(F.col("slide_path"))).alias("patient"))
    return paths, given.unionByName(opened).distinct(), m


def slide_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    paths, edges, m = slide_edges(spark, d)
    return related(cut(paths), cut(edges), "slide_path", "patient"), m


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    groups, _ = slide_groups(spark, d)
    groups = cut(groups.filter(F.col("component").isNotNull()))
    anchors = groups.groupBy("component").agg(F.min("slide_path").alias("anchor_path"))
    return join_one(groups, anchors, "component", F.col("slide_path")).filter("slide_path > anchor_path").select("anchor_path", "slide_path")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    groups, m = slide_groups(spark, d)
    label = m.groupBy("slide_path").agg(F.max(project_key(F.col("cancer_type"))).alias("label"))
    records = groups.join(label, "slide_path", "left")
    return grouped_split(
        records, "component", "label", {"train": 0.8, "validation": 0.1, "test": 0.1}, record="slide_path",
    ).select("slide_path", "split")


def slide_sample(spark: SparkSession, d: str) -> BalancedSample:
    return BalancedSample(
        _table(spark, d, "slide_metadata"), _table(spark, d, "sample_targets"), id="slide_path", levels=["cancer_type", "sample_type"],
        share="target_share", least="min_rows", fraction=0.25, keys=[project_key, key_of],
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return slide_sample(spark, d).report().filter("short").select("cancer_type", "sample_type")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return slide_sample(spark, d).sample.select("cancer_type", "sample_type", "slide_path")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    columns = ["cancer_type", "sample_type", "quota", "n_available", "n_taken", "n_extra", "n_drawn", "short"]
    return slide_sample(spark, d).report().select(*columns, F.round("actual_share", 9).alias("actual_share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def source_mix(spark: SparkSession, d: str) -> Mix:
    return Mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return source_mix(spark, d).report().filter("cannot_fill").select("source")


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return source_mix(spark, d).mix.select("doc_id", "source", "n_tokens", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(_table(spark, d, "documents"), min_length=400).pairs()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(_table(spark, d, "documents"), min_length=400).report().withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        p1_found, p2_percentiles, p2_days, p3_found, p3_split, p4_found, p4_sample, p4_report, p5_found, p6_found, p6_mix, p7_found,
        p7_report,
    ]
    return {"p1_best": best_patches} | {f.__name__: f for f in found}


_VALID = """
  SELECT slide_path, draw, max(tissue_fraction) AS v, max(mpp) AS m, min(CAST(extracted_at AS DATE)) AS day
  FROM patches WHERE NOT isnan(tissue_fraction) AND tissue_fraction BETWEEN 0 AND 1 AND slide_path IS NOT NULL AND draw IS NOT NULL
  GROUP BY 1, 2"""
_KEY = r"nullif(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"
_PROJECT = f"(CASE WHEN {_KEY.format('cancer_type')} LIKE 'tcga %' THEN {_KEY.format('cancer_type')} ELSE 'tcga ' || {_KEY.format('cancer_type')} END)"
_FRACTIONS = f"""
  WITH once AS ({_VALID}),
  kind AS (SELECT slide_path, max(upper(replace({_PROJECT}, ' ', '-'))) AS cancer_type FROM slide_metadata GROUP BY 1),
  rows AS (SELECT o.v, o.day, k.cancer_type, CASE WHEN o.m > 0 AND NOT isnan(o.m) THEN round(o.m, 2) END AS mpp FROM once o LEFT JOIN kind k USING (slide_path))"""
_NAMES = r"""
  paths AS (SELECT slide_path FROM slide_metadata WHERE slide_path IS NOT NULL UNION SELECT slide_path FROM patches WHERE slide_path IS NOT NULL),
  parts AS (
    SELECT slide_path, unnest(string_split(regexp_replace(upper(patient_id), '[^A-Z0-9]+', '-', 'g'), 'TCGA-')) AS x FROM slide_metadata WHERE slide_path IS NOT NULL
    UNION ALL
    SELECT slide_path, regexp_extract(upper(regexp_extract(slide_path, '([^/]*)$', 1)), '^TCGA-([A-Z0-9]{2}-[A-Z0-9]{4})([^A-Z0-9]|$)', 1) FROM paths),
  named AS (SELECT DISTINCT slide_path, regexp_extract(x, '^-?([A-Z0-9]{2}-[A-Z0-9]{4})([^A-Z0-9]|$)', 1) AS e FROM parts),
  edges AS (SELECT * FROM named WHERE e <> '' AND length(replace(replace(e, substr(e, 1, 1), ''), '-', '')) > 0),
  links AS (SELECT DISTINCT a.e AS a, b.e AS b FROM edges a JOIN edges b USING (slide_path) WHERE a.e <> b.e),
  reach AS (SELECT DISTINCT e AS a, e AS b FROM edges UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  label AS (SELECT a AS e, min(b) AS c FROM reach GROUP BY 1),
  member AS (SELECT DISTINCT slide_path, c FROM edges JOIN label USING (e)),
  anchor AS (SELECT c, min(slide_path) AS anchor_path FROM member GROUP BY 1)"""
_LEAVES = f"""
  one AS (SELECT slide_path, max({_PROJECT}) AS pk, max({_KEY.format('sample_type')}) AS sk FROM slide_metadata WHERE slide_path IS NOT NULL GROUP BY 1),
  have AS (SELECT pk, sk, count(*) AS n FROM one WHERE pk IS NOT NULL AND sk IS NOT NULL GROUP BY 1, 2),
  named AS (SELECT *, {_PROJECT} AS pk, {_KEY.format('sample_type')} AS sk FROM sample_targets),
  size AS (SELECT count(*) // 4 AS n FROM one),
  leaf AS (SELECT t.*, t.target_share AS w, coalesce(h.n, 0) AS n_available, coalesce(h.n, 0) < greatest(t.min_rows, t.target_share * (SELECT n FROM size)) AS short
    FROM named t LEFT JOIN have h USING (pk, sk))"""


def _shared_sql(name: str, kids: str) -> str:
    """``name``: the parts ``got`` of ``q`` by weight between ``lo`` and ``hi`` of the rows ``p, name, w, lo, hi, q``, tried at every point of change."""
    return f"""
  {name}_e AS (SELECT p, lo / w AS t FROM {kids} WHERE w > 0 UNION SELECT p, hi / w FROM {kids} WHERE w > 0),
  {name}_f AS (SELECT e.p, e.t, max(k.q) AS q, sum(CASE WHEN k.w > 0 THEN least(k.hi, greatest(k.lo, e.t * k.w)) ELSE k.lo END) AS f,
    sum(CASE WHEN k.w > 0 AND k.lo / k.w <= e.t AND e.t < k.hi / k.w THEN k.w ELSE 0 END) AS s FROM {name}_e e JOIN {kids} k USING (p) GROUP BY 1, 2),
  {name}_l AS (SELECT p, arg_max(CASE WHEN s > 1e-12 THEN t + (q - f) / s ELSE t END, t) AS x FROM {name}_f WHERE f <= q + 1e-9 GROUP BY 1),
  {name}_v AS (SELECT k.*, CASE WHEN w > 0 THEN least(hi::DOUBLE, greatest(lo::DOUBLE, coalesce(x, 0) * w)) ELSE lo END AS v FROM {kids} k LEFT JOIN {name}_l USING (p)),
  {name}_b AS (SELECT *, floor(v + 1e-9)::BIGINT AS b FROM {name}_v),
  {name} AS (SELECT p, name, (b + CASE WHEN b < hi AND row_number() OVER (PARTITION BY p ORDER BY b >= hi, round(v - b, 9) DESC, name)
    <= q - sum(b) OVER (PARTITION BY p) THEN 1 ELSE 0 END)::BIGINT AS got FROM {name}_b)"""


_TAKEN = f"""
  WITH {_LEAVES.strip()},
  room AS (SELECT *, CASE WHEN w > 0 THEN 10**15 ELSE min_rows END::BIGINT AS most, CASE WHEN w > 0 THEN n_available ELSE least(n_available, min_rows) END AS can FROM leaf),
  root AS (SELECT greatest((SELECT n FROM size), sum(min_rows))::BIGINT AS q, sum(can)::BIGINT AS can FROM room),
  q1k AS (SELECT '' AS p, pk AS name, sum(w) AS w, sum(min_rows)::BIGINT AS lo, sum(most)::BIGINT AS hi, (SELECT q FROM root) AS q FROM room GROUP BY pk),
  {_shared_sql('q1', 'q1k').strip()},
  q2k AS (SELECT pk AS p, sk AS name, w, min_rows::BIGINT AS lo, most AS hi, got AS q FROM room JOIN q1 ON q1.name = pk),
  {_shared_sql('q2', 'q2k').strip()},
  t1k AS (SELECT '' AS p, pk AS name, sum(w) AS w, least(max(got), sum(can))::BIGINT AS lo, sum(can)::BIGINT AS hi, (SELECT least(q, can) FROM root) AS q
    FROM room JOIN q1 ON q1.name = pk GROUP BY pk),
  {_shared_sql('t1', 't1k').strip()},
  t2k AS (SELECT pk AS p, sk AS name, w, least(q2.got, can)::BIGINT AS lo, can::BIGINT AS hi, t1.got AS q
    FROM room JOIN t1 ON t1.name = pk JOIN q2 ON q2.p = pk AND q2.name = sk),
  {_shared_sql('t2', 't2k').strip()},
  plan AS (SELECT r.*, q2.got AS quota, t2.got AS n_taken FROM room r JOIN q2 ON q2.p = pk AND q2.name = sk JOIN t2 ON t2.p = pk AND t2.name = sk)"""
_SOURCE = r"regexp_replace(regexp_replace(lower(source), '[\s\p{Z}\p{Pd}_.]+', '_', 'g'), '^_+|_+$', '', 'g')"

# Windows of 400 characters that stand in two documents, by their digest.
_WINDOWS = """
  every AS (SELECT doc_id, i, md5_number(substr(text, i, 400)) AS h FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 400)),
  w AS (SELECT * FROM every SEMI JOIN (SELECT h FROM every GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h))"""
_SPANS = f"""
  WITH {_WINDOWS.strip()},
  twos AS (SELECT a.doc_id, b.doc_id AS other, a.i - b.i AS shift, a.i FROM w a JOIN w b ON a.h = b.h AND a.doc_id <> b.doc_id),
  runs AS (SELECT doc_id, other, shift, min(i) AS s, max(i) + 400 AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS g FROM twos) GROUP BY doc_id, other, shift, g),
  far AS (SELECT doc_id, s, max(e) AS e FROM runs GROUP BY 1, 2),
  kept AS (SELECT doc_id, s, e, r FROM (
    SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM far) WHERE r IS NULL OR e > r),
  found AS (SELECT doc_id, sum(e - greatest(s, coalesce(r, s))) AS shared, count(*) AS n, max(e - s) AS most FROM kept GROUP BY 1)
  SELECT doc_id, length(text) AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars,
    CASE WHEN length(text) > 0 THEN coalesce(shared, 0)::DOUBLE / length(text) ELSE 0.0::DOUBLE END AS shared_share,
    coalesce(n, 0)::BIGINT AS n_spans, coalesce(most, 0)::BIGINT AS longest_span
  FROM documents LEFT JOIN found USING (doc_id)"""


def _words_sql(table: str, key: str) -> str:
    """``key, w``: the words of each text, by another engine's means: markup, accents, hyphens and case undone by patterns without look-around."""
    steps = [
        (r"\\+-", ""), (r"\\+(?:[`''^\"~=.]\s*\{?|[uvHtcdbrk]\{)\\?([A-Za-z])\}?", r"\1"),
        (r"\\+(?:cite[a-z]*|[a-z]*ref|label)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}", " "), (r"\\+[A-Za-z@]+\*?", " "),
        *[(r"([A-Za-z])-(?:[ \t]*\r?\n[ \t>%]*)?([A-Za-z])", r"\1\2")] * 2,
    ]
    folded = "lower(strip_accents(nfc_normalize(lower(text))))"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("‐", "-"), ("‑", "-")):
        folded = f"replace({folded}, '{a}', '{b}')"
    folded = f"regexp_replace({folded}, '[\u00ad\u200b-\u200d\u2060\ufeff]', '', 'g')"
    x = f"CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN regexp_replace({folded}, '([^\\x00-\\x7F])', ' \\1 ', 'g') ELSE text END"
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"SELECT {key}, list_filter(string_split_regex(lower({x}), '[^a-z0-9\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"


_LEAKS = f"""
  WITH dw AS ({_words_sql('documents', 'doc_id')}), iw AS ({_words_sql('(SELECT DISTINCT item_id, text FROM eval_items)', 'item_id')}),
  ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
  its AS (SELECT item_id, m, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, len(w) AS m, unnest(range(1, len(w) - 3)) AS i FROM iw)),
  hit AS (SELECT doc_id, item_id, m, unnest(range(i, i + 5)) AS k FROM ds JOIN its USING (s))
  SELECT doc_id, item_id FROM hit GROUP BY 1, 2 HAVING count(DISTINCT k) >= max(m) * 0.5"""


def oracle_sql() -> dict[str, str]:
    """No SQL for p3_split (a sequence of choices) and p6_mix (a tokenizer): these are tested against brute force."""
    best = f"WITH once AS ({_VALID}), r AS (SELECT slide_path, draw, v AS tissue_fraction, row_number() OVER (PARTITION BY slide_path ORDER BY v DESC, draw) AS rank FROM once)"
    return {
        "p1_best": f"{best} SELECT slide_path, draw, tissue_fraction, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5",
        "p1_found": f"{best} SELECT slide_path, draw FROM r WHERE rank <= 5",
        "p2_percentiles": f"""{_FRACTIONS}, ps AS (SELECT unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in POINTS)}]) AS p),
          qs AS (SELECT cancer_type, mpp, count(*) AS n_values, quantile_cont(v, [{', '.join(map(str, POINTS))}]) AS q FROM rows GROUP BY 1, 2)
          SELECT cancer_type, mpp, n_values, CAST(unnest([{', '.join(map(str, POINTS))}]) AS DOUBLE) AS p, round(unnest(q), 9) AS percentile FROM qs""",
        "p2_days": f"{_FRACTIONS} SELECT day, cancer_type, mpp, count(*) AS n_values, round(quantile_cont(v, 0.5), 9) AS median FROM rows GROUP BY 1, 2, 3",
        "p3_found": f"WITH RECURSIVE {_NAMES.strip()} SELECT anchor_path, slide_path FROM member JOIN anchor USING (c) WHERE slide_path > anchor_path",
        "p4_found": f"WITH {_LEAVES.strip()} SELECT cancer_type, sample_type FROM leaf WHERE short",
        "p4_report": f"""{_TAKEN} SELECT cancer_type, sample_type, quota, n_available, n_taken, greatest(n_taken - quota, 0) AS n_extra, n_taken AS n_drawn, short,
          round(n_taken / (SELECT sum(n_taken) FROM plan), 9) AS actual_share FROM plan""",
        "p4_sample": f"""{_TAKEN}, r AS (SELECT *, row_number() OVER (PARTITION BY pk, sk ORDER BY {bits_sql(0, 'slide_path')}, slide_path) AS k FROM one)
          SELECT cancer_type, sample_type, slide_path FROM r JOIN plan USING (pk, sk) WHERE k <= n_taken""",
        "p5_found": _LEAKS,
        "p7_found": f"WITH {_WINDOWS.strip()} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p7_report": _SPANS,
        "p6_found": f"""
          WITH size AS (SELECT {_SOURCE} AS s, sum(len(regexp_extract_all(text, '\\w+|[^\\w\\s]'))) AS k FROM documents GROUP BY 1),
          have AS (SELECT t.source, t.target_weight, t.max_repeats, coalesce(z.k, 0) AS k FROM mix_targets t LEFT JOIN size z ON z.s = t.source)
          SELECT source FROM have WHERE k * max_repeats < target_weight * (SELECT sum(k) FROM have)""",
    }
