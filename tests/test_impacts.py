"""Exact top-k over blocks with bounds, against adding everything up."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from irspan.functions.text import PLAIN
from irspan.operators import impacts, physical
from irspan.operators.bm25 import BM25Retriever, LexicalIndex
from irspan.operators.ranking import top_k


def weight(field, x, y):
    return x / (1 + y)


def made(seed, terms=30, docs=400):
    r = random.Random(seed)
    return [("f", f"t{t}", f"d{d:03}", r.choice([1, 1, 1, 2, 5, 40]), r.randrange(4)) for t in range(terms) for d in r.sample(range(docs), r.choice([3, 40, docs]))]


def everything(rows, asked):
    out = defaultdict(float)
    for query, field, term, w in asked:
        for f, t, d, x, y in rows:
            if (f, t) == (field, term):
                out[query, d] += w * x / (1 + y)
    return out


def shard(rows):
    by = defaultdict(list)
    for f, t, d, x, y in rows:
        by[f, t].append({"doc": d, "x": float(x), "y": float(y)})
    keys = sorted(by)
    kind = pa.list_(pa.struct([("doc", pa.string()), ("x", pa.float64()), ("y", pa.float64())]))
    return pa.table({"shard": pa.array([0] * len(keys), pa.int32()), "field": [k[0] for k in keys], "term": [k[1] for k in keys], "entries": pa.array([by[k] for k in keys], kind), "n": [len(by[k]) for k in keys], "most": [max(e["x"] for e in by[k]) for k in keys], "least": [min(e["y"] for e in by[k]) for k in keys]})


@pytest.mark.parametrize("k", [1, 3, 10, 399, 1000])
@pytest.mark.parametrize("signed", [False, True])
def test_a_shard_loses_nothing(k, signed):
    """Every document that rounding lets tie with the k-th is there, with its full score."""
    r = random.Random(k)
    rows = made(k)
    for _ in range(20):
        wanted = [(("f", f"t{t}"), r.choice([0.1, 1.0, 3.0, -1.0 if signed else 2.0])) for t in r.sample(range(33), r.randrange(1, 12))]
        here = impacts._Shard(shard(rows), weight)
        docs, scores = here.top(wanted, k)
        full = {d: s for (_, d), s in everything(rows, [("q", f, t, w) for (f, t), w in wanted]).items() if s > 0}
        best = sorted((-round(s, 6), d) for d, s in full.items())[:k]
        found = dict(zip(here.names.take(pa.array(docs)).to_pylist(), scores.tolist(), strict=True))
        assert sorted((-round(s, 6), d) for d, s in found.items())[:k] == best
        assert all(abs(full[d] - s) < 1e-9 for d, s in found.items())
        assert here.scored <= here.met


def test_a_strong_term_leaves_the_rest_out():
    rows = [("f", "rare", f"d{i:04}", 100, 0) for i in range(20)] + [("f", f"common{t}", f"d{i:04}", 1, 0) for t in range(5) for i in range(5000)]
    here = impacts._Shard(shard(rows), weight)
    docs, scores = here.top([(("f", t), 1.0) for t in ("rare", *(f"common{i}" for i in range(5)))], 10)
    assert len(docs) == 20 and set(scores) == {105.0}  # all twenty tie
    assert (here.met, here.scored) == (25020, 20 + 20 * 5)


def test_an_index_and_a_reopened_one(spark, monkeypatch):
    """Query terms in parts, shards of any number, blocks that batches cut through."""
    rows = made(1, terms=12, docs=60) + [("g", "t1", f"d{i:03}", 2, 1) for i in range(0, 60, 7)]
    r = random.Random(3)
    asked = [(f"q{i}", r.choice("ffg"), f"t{t}", r.random()) for i in range(25) for t in r.sample(range(14), 5)]
    df = spark.createDataFrame([(*x[:3], float(x[3]), x[4]) for x in rows], "field string, term string, doc_id string, x double, y int")
    terms = spark.createDataFrame(asked, "query_id string, field string, term string, weight double")
    full = defaultdict(list)
    for (q, d), s in everything(rows, asked).items():
        full[q].append((-round(s, 6), d))
    want = {(q, d, -s) for q, x in full.items() for s, d in sorted(x)[:5]}
    monkeypatch.setattr(impacts, "SHARD_POSTINGS", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        index = impacts.ImpactIndex.build(df, physical.shared_folder(spark, "impacts"))
        assert index.shards == -(-len(rows) // 40)
        for part in (10_000, 30):
            monkeypatch.setattr(impacts, "BROADCAST_ROWS", part)
            for x in (index, impacts.ImpactIndex.open(spark, index.folder)):
                assert {(y.query_id, y.doc_id, y.score) for y in top_k(x.best(terms, weight, 5), 5).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(x) for x in index.postings().collect()} == {(f, t, d, float(x), float(y)) for f, t, d, x, y in rows}
    assert "Exchange" not in index.blocks.groupBy("shard").applyInArrow(lambda t: t.select(["shard"]), "shard int")._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert not os.path.exists(f"{index.folder}/blocks")


def test_searches_leave_nothing_behind(spark):
    corpus = spark.createDataFrame([(f"d{i}", "", f"w{i % 3} w{i % 5} x") for i in range(30)], "doc_id string, title string, text string")
    found = BM25Retriever(tokenizer=PLAIN).index(corpus)
    folder = os.path.dirname(found.indexed.folder)
    before = set(os.listdir(folder))
    queries = spark.createDataFrame([("a", "w1 x"), ("b", "nothing")], "query_id string, text string")
    runs = [found.retrieve(queries, 3) for _ in range(3)]
    assert set(os.listdir(folder)) == before and len({tuple(map(tuple, r.collect())) for r in runs}) == 1
    assert LexicalIndex.open(spark, found.indexed.folder).postings().count() == found.indexed.postings().count()
    effort = found.effort(queries, 3).collect()
    assert sum(r.postings for r in effort) == 30 + sum(i % 3 == 1 or i % 5 == 1 for i in range(30)) and all(r.scored <= r.postings for r in effort)
    np.testing.assert_array_equal(sorted(r.queries for r in effort) != [], True)


def test_documents_are_moved_whole(spark, monkeypatch, tmp_path):
    """An index keeps a row a field of a document; postings come from the shards that batches and blocks cut through."""
    monkeypatch.setattr(impacts, "WRITTEN", 5)
    monkeypatch.setattr(impacts, "SHARD_POSTINGS", 20)
    texts = {f"d{i:02}": " ".join(f"w{j}" for j in range(i % 7) for _ in range(1 + (i + j) % 3)) for i in range(40)}
    corpus = spark.createDataFrame([(d, "", t) for d, t in texts.items()], "doc_id string, title string, text string")
    index = LexicalIndex.build(corpus, PLAIN, folder=str(tmp_path / "index"))
    assert index.documents.count() == 40 and index.impacts.shards > 4
    want = {("contents", d, len(t.split()), w, t.split().count(w)) for d, t in texts.items() for w in t.split()}
    assert {tuple(r) for r in index.postings().collect()} == want
    assert {tuple(r) for r in index.impacts.postings().collect()} == {(f, w, d, float(tf), float(dl)) for f, d, dl, w, tf in want}


def test_of_equal_scores_a_shard_sends_the_least_ids(spark):
    rows = [("f", "t", f"d{i:04}", 1, 0) for i in range(500)]
    here = impacts._Shard(shard(rows[::-1]), weight)
    docs, scores = here.top([(("f", "t"), 1.0)], 3)
    assert len(docs) == 500
    assert sorted(here.names.take(docs[here.first(docs, scores, 3)]).to_pylist()) == ["d0000", "d0001", "d0002"]
    cells = (np.arange(500) % 2)[np.argsort(docs)]
    kept = here.first(docs, scores, 3, cells)
    assert len(kept) == 6 and sorted(cells[kept].tolist()) == [0, 0, 0, 1, 1, 1]
