"""The queries of this package against SQL, where there is any, at the smallest scale."""

import os

import duckdb
import pytest

from patchloom.llm import queries as llm

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: f"{float(v):.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_against_sql(spark, name):
    df = llm.queries()[name](spark, FOLDER)
    got = df.collect()
    assert len({tuple(r) for r in got}) == len(got)
    if name not in llm.oracle_sql():
        return
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    want = db.sql(llm.oracle_sql()[name])
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_columns_of_the_found_queries(spark):
    want = {
        "p1": ["slide_path", "draw"], "p3": ["anchor_path", "slide_path"], "p4": ["cancer_type", "sample_type"],
        "p5": ["doc_id", "item_id"], "p6": ["source"], "p7": ["doc_a", "doc_b"],
    }
    for p, c in want.items():
        assert llm.queries()[f"{p}_found"](spark, FOLDER).columns == c
