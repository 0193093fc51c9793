import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchloom.operators import metadata
from patchloom.plans import acquire

CASES = [
    ("/wsi/TCGA-AAAA/TCGA-Q7-ZX09-01Z-00-DX1.svs", "TCGA-Q7-ZX09", "Primary Solid Tumor", "TCGA-AAAA", False),
    ("/wsi/TCGA-BBBB/TCGA-41-K2K2-02B-07-TS2.svs", "TCGA-41-K2K2", "Recurrent Solid Tumor", "TCGA-BBBB", True),
    ("/wsi/TCGA-CCCC/TCGA-P0-1234-11A-03-MS9.svs", "TCGA-P0-1234", "Solid Tissue Normal", "TCGA-CCCC", True),
    ("/wsi/TCGA-DDDD/TCGA-88-W4W5-06A-01-BS1.svs", "TCGA-88-W4W5", "Metastatic", "TCGA-DDDD", True),
    ("/wsi/no barcode.svs", None, None, None, None),
    ("/wsi/loose/TCGA-Q7-ZX09-01Z-00-DX1.svs", "TCGA-Q7-ZX09", "Primary Solid Tumor", None, False),
    ("/wsi/TCGA-EEEE/copy-TCGA-Q7-ZX09-01Z-00-DX1.svs", None, None, None, None),
    ("/wsi/TCGA-EEEE/TCGA-Q7-ZX09-99Z-00-DX3.11AA22BB-CCDD.svs", "TCGA-Q7-ZX09", "Unknown (99)", "TCGA-EEEE", False),
]


def test_barcodes(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "path string")
    got = {r.path: r for r in metadata.parse_barcode(df).collect()}
    for path, patient, kind, cancer, frozen in CASES:
        r = got[path]
        assert (r.patient_id, r.sample_type, r.cancer_type, r.is_frozen) == (patient, kind, cancer, frozen)
        assert (r.parse_error is None) == (patient is not None)
    assert got[CASES[-1][0]].barcode == "TCGA-Q7-ZX09-99Z-00-DX3"
    assert metadata.unparsed(metadata.parse_barcode(df)).first().n == 2
    flat = {r.path: r for r in metadata.flat(metadata.parse_barcode(df), metadata.EXTRA).collect()}
    assert flat["/wsi/no barcode.svs"].patient_id == "" and flat["/wsi/no barcode.svs"].extra == '{"parse_error":"Could not parse barcode from: no barcode"}'
    with pytest.warns(UserWarning) as told:
        assert metadata.warn_unparsed(metadata.parse_barcode(df)) == 2
    assert len([w for w in told if "barcodes" in str(w.message) or "cancer type" in str(w.message)]) == 2
    assert metadata.parse_barcode(df.limit(1), cancer_type="TCGA-OWN").first().cancer_type == "TCGA-OWN"


def test_hits(spark):
    ddl = "file_id string, file_name string, file_size long, md5sum string, state string, cases array<struct<project:struct<project_id:string>>>"
    rows = [
        ("1", "a.svs", 5, "m", "released", [(("TCGA-BRCA",),)]), ("2", "b.svs", None, None, None, []), ("3", "c.svs", 1, "x", "s", None),
    ]
    got = {r.file_id: r.cancer_type for r in metadata.hits(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {"1": "TCGA-BRCA", "2": "unknown", "3": "unknown"}
    terms = lambda *a: [(t["op"], t["content"]["field"], t["content"]["value"]) for t in metadata.query_filter(*a)["content"]]
    image = [("=", "files.data_type", "Slide Image"), ("=", "files.data_format", "SVS")]
    assert metadata.query_filter()["op"] == "and" and terms(None, "all") == image
    assert terms("TCGA-X")[2:] == [("=", "cases.project.project_id", "TCGA-X"), ("=", "files.experimental_strategy", "Diagnostic Slide")]
    assert terms(["TCGA-X"], "all")[2:] == [("=", "cases.project.project_id", "TCGA-X")]
    assert terms(["TCGA-X", "TCGA-Y"], "frozen")[2:] == [("in", "cases.project.project_id", ["TCGA-X", "TCGA-Y"]), ("=", "files.experimental_strategy", "Tissue Slide")]
    with pytest.raises(ValueError):
        metadata.query_filter(None, "other")


def test_query_in_one_call(spark, tmp_path, caplog):
    hits = [
        {"file_id": f"{c}{i}", "file_name": f"{c}{i}.svs", "file_size": 1 << 29, "md5sum": None, "state": "released", "cases": [{"project": {"project_id": f"TCGA-{c}"}}]}
        for c in "AB" for i in range(10)
    ]
    (tmp_path / "a.json").write_text(json.dumps({"data": {"hits": hits}}))
    with caplog.at_level("INFO"):
        rows = acquire.query_slides(spark, str(tmp_path / "a.json"), most_per_type=3, seed=1, page=7).collect()
    assert Counter(r.cancer_type for r in rows) == {"TCGA-A": 3, "TCGA-B": 3} and {r.md5sum for r in rows} == {""}
    assert "TCGA-A: 3 slides, 1.5 GB" in caplog.text and "all: 6 slides, 3.0 GB" in caplog.text
    again = acquire.query_slides(spark, str(tmp_path / "a.json"), most_per_type=3, seed=1).collect()
    assert {r.file_id for r in again} == {r.file_id for r in rows}
    (tmp_path / "none.json").write_text(json.dumps({"data": {"hits": []}}))
    assert acquire.query_slides(spark, str(tmp_path / "none.json")).isEmpty() and "no slides" in caplog.text


def test_download_in_one_call(spark, tmp_path):
    m = manifest(spark).filter("cancer_type is not null and file_size is not null")

    def fetch(file_id, part):
        with open(part, "wb") as f:
            f.truncate(1 << 30)

    assert [r.ok for r in acquire.download_slides(m, str(tmp_path / "d"), fetch).collect()] == [True]
    assert acquire.download_slides(m, str(tmp_path / "d"), fetch).isEmpty()

    def lost(file_id, part):
        raise OSError("gone")

    with pytest.raises(RuntimeError, match="1 files failed.*gone"):
        acquire.download_slides(m, str(tmp_path / "d"), lost, skip_existing=False)


def manifest(spark):
    rows = [
        ("1", "a.svs", 1 << 30, "TCGA-A", "m", "released"), ("2", "b.svs", None, "TCGA-A", None, None),
        ("3", "c.svs", 1 << 29, None, "m", "error"), ("1", "a.svs", 1 << 30, "TCGA-A", "m", "submitted"),
    ]
    return spark.createDataFrame(rows, "file_id string, filename string, file_size long, cancer_type string, md5sum string, state string")


def test_summary_and_sink(spark, tmp_path):
    m = manifest(spark)
    got = {(r.cancer_type, r.is_total): (r.n, r.gb) for r in metadata.summary(m).collect()}
    assert got == {("TCGA-A", 0): (3, 2.0), (None, 0): (1, 0.5), (None, 1): (4, 2.5)}
    metadata.save_manifest(metadata.latest(m), str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("*.csv")).read_text().splitlines()
    assert text[0] == "id\tfilename\tmd5\tsize\tstate" and len(text) == 4
    assert {r.file_id: r.state for r in metadata.latest(m).collect()}["1"] == "released"


def test_missing_and_download(spark, tmp_path):
    m = manifest(spark).filter("cancer_type is not null")
    have = spark.createDataFrame([(f"{tmp_path}/TCGA-A/a.svs", 5)], "dest string, size long")
    todo = metadata.missing(m, have, str(tmp_path))
    assert sorted(r.filename for r in todo.collect()) == ["a.svs", "b.svs"]
    same = have.withColumn("size", F.lit(1 << 30))
    assert [r.filename for r in metadata.missing(m, same, str(tmp_path)).collect()] == ["b.svs"]

    def fetch(file_id, part):
        if file_id == "2":
            raise OSError("gone")
        with open(part, "w") as f:
            f.write(file_id)

    got = {r.dest: (r.ok, r.error) for r in metadata.download(todo, fetch).collect()}
    assert got == {f"{tmp_path}/TCGA-A/a.svs": (True, None), f"{tmp_path}/TCGA-A/b.svs": (False, "gone")}
    assert (tmp_path / "TCGA-A/a.svs").read_text() == "1" and not (tmp_path / "TCGA-A/b.svs").exists()


def test_paths(spark, tmp_path):
    from patchloom.sources.paths import listing, resolve, slide_paths

    for n in ("b.SVS", "a.svs", "x.txt", "sub/c.tiff"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("1")
    got = resolve(tmp_path)
    assert [p.rsplit("/", 1)[1] for p in got] == ["a.svs", "b.SVS", "c.tiff"]
    assert resolve(["s3://x/y", str(tmp_path / "x.txt"), "s3://x/y"]) == ["s3://x/y", str(tmp_path / "x.txt"), "s3://x/y"]
    (tmp_path / "empty").mkdir()
    for bad in (tmp_path / "none", tmp_path / "empty"):
        with pytest.raises(FileNotFoundError):
            resolve(bad)
    assert slide_paths(spark, tmp_path).count() == 3
    assert listing(spark, str(tmp_path)).count() == 3
