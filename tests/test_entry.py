import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from irspan import queries as retrieval

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
CHECKED = ["bm25_top10", "bm25_multifield", "rm3_top10", "per_query_long", "dense_maxp", "maxsim_top10", "rrf_weighted", "rerank_depth", "route_runs", "terciles", "expansion_stats", "calibrate", "judge_thinning", "sweep_bm25"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, db, name):
    df = retrieval.queries()[name](spark, SMALL)
    found = db.execute(retrieval.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_all_sql_binds(db):
    for name, sql in retrieval.oracle_sql().items():
        assert name in retrieval.queries()
        db.execute(f"EXPLAIN {sql}")


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(retrieval.queries()) <= set(entry.queries())
