"""Vectors, retrievers, fusion, routing, measures and sweeps on small made-up runs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irspan.functions.text import PLAIN
from irspan.operators import combine, expansion, impacts, metrics, retrievers, sweeps, vectors
from irspan.operators.bm25 import BM25Retriever
from irspan.operators.rm3 import RM3Retriever

TREES = "oak birch maple willow cedar larch".split()


def scores(run):
    return {(r.query_id, r.doc_id): r.score for r in run.collect()}


def run_of(spark, rows):
    return spark.createDataFrame([(q, d, float(s)) for q, d, s in rows], "query_id string, doc_id string, score double")


def corpus_of(spark, texts):
    return spark.createDataFrame([(d, "", t) for d, t in texts.items()], "doc_id string, title string, text string")


def asked(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "query_id string, text string")


# ---- vectors


def vectors_of(seed, n, dim=5):
    r = np.random.default_rng(seed)
    return [[float(x) for x in np.round(r.standard_normal(dim), 1)] for _ in range(n)]


@pytest.mark.parametrize(("pass_bytes", "block"), [(128 << 20, 4 << 20), (200, 80)])
def test_nearest_by_cosine(spark, monkeypatch, pass_bytes, block):
    """All chunks of all documents, in several passes and blocks, against NumPy."""
    monkeypatch.setattr(vectors, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    d, q = vectors_of(1, 90), vectors_of(2, 12)
    documents = spark.createDataFrame([(f"d{i // 3}", v) for i, v in enumerate(d)], "doc_id string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(q)], "query_id string, embedding array<double>")
    unit = lambda x: np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = np.round(unit(q) @ unit(d).T, 6).reshape(12, 30, 3).max(axis=2)
    want = {}
    for i in range(12):
        for j in sorted(range(30), key=lambda j: (-cosines[i, j], f"d{j}"))[:7]:
            want[f"q{i}", f"d{j}"] = cosines[i, j]
    assert scores(vectors.dense_retrieve(queries, documents, 7)) == pytest.approx(want)
    assert not vectors.dense_retrieve(queries.where("query_id = 'none'"), documents).count()


@pytest.mark.parametrize(("pass_bytes", "block"), [(128 << 20, 4 << 20), (400, 100)])
def test_late_interaction(spark, monkeypatch, pass_bytes, block):
    monkeypatch.setattr(vectors, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    r = random.Random(3)
    d = {f"d{i}": vectors_of(10 + i, r.randrange(1, 6)) for i in range(25)}
    q = {f"q{i}": vectors_of(90 + i, r.randrange(1, 5)) for i in range(8)}
    rows = lambda x, name: spark.createDataFrame([(k, i, v) for k, vs in x.items() for i, v in enumerate(vs)], f"{name} string, pos int, embedding array<double>").repartition(3)
    want = {}
    for a, qs in q.items():
        all_ = {b: round(float((np.array(qs) @ np.array(ds).T).max(axis=1).sum()), 6) for b, ds in d.items()}
        want |= {(a, b): all_[b] for b in sorted(all_, key=lambda b: (-all_[b], b))[:4]}
    assert scores(vectors.maxsim_retrieve(rows(q, "query_id"), rows(d, "doc_id"), 4)) == pytest.approx(want)
    lost = rows(d, "doc_id").unionByName(spark.createDataFrame([("dx", 0, None)], "doc_id string, pos int, embedding array<double>"))
    with pytest.raises(Exception, match="no token is left of document dx"):
        vectors.maxsim_retrieve(rows(q, "query_id"), lost).collect()


def test_learned_weights(spark):
    logits = spark.createDataFrame([("x", 0, [math.e - 1, -3.0, 0.0]), ("x", 1, [0.0, math.e**2 - 1, -1.0]), ("y", 0, [0.5, 0.25, 0.0])], "doc_id string, pos int, embedding array<double>")
    weights = {(r.doc_id, r.term_id): r.weight for r in vectors.sparse_encode(logits).collect()}
    assert weights == pytest.approx({("x", 0): 1, ("x", 1): 2, ("y", 0): math.log(1.5), ("y", 1): math.log(1.25)}, abs=1e-6)
    assert {(r.doc_id, r.term_id) for r in vectors.sparse_encode(logits, 1).collect()} == {("x", 1), ("y", 0)}
    query = spark.createDataFrame([("q", 1, 3.0), ("q", 7, 1.0)], "query_id string, term_id int, weight double")
    assert scores(vectors.sparse_retrieve(query, vectors.sparse_encode(logits))) == pytest.approx({("q", "x"): 6, ("q", "y"): 3 * math.log(1.25)}, abs=1e-5)


# ---- retrievers


def woods(spark):
    r = random.Random(8)
    return corpus_of(spark, {f"w{i:02}": " ".join(r.choices(TREES, k=r.randrange(2, 12))) for i in range(20)})


def all_retrievers():
    v = vectors.VocabularyEncoder(tuple(TREES))
    lexical = BM25Retriever(tokenizer=PLAIN)
    return {
        "bm25": lexical,
        "rm3": RM3Retriever(tokenizer=PLAIN),
        "dense": retrievers.DenseRetriever(v, 3, 1, max_tokens=2),
        "sparse": retrievers.SparseRetriever(v),
        "late": retrievers.LateInteractionRetriever(v),
        "fused": retrievers.FusedRetriever((lexical, retrievers.DenseRetriever(v)), k=5),
        "reranked": retrievers.RerankedRetriever(lexical, F.length("text"), 3),
    }


@pytest.mark.parametrize("name", ["bm25", "rm3", "dense", "sparse", "late", "fused", "reranked"])
def test_every_retriever_keeps_the_protocol(spark, name):
    made = all_retrievers()[name]
    assert isinstance(made, retrievers.Retriever)
    with pytest.raises(RuntimeError, match="index"):
        made.retrieve(asked(spark, a="oak")).collect()
    indexed = made.index(woods(spark))
    rows = indexed.retrieve(asked(spark, a="oak cedar", b="larch"), 4).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {"a", "b"} and max(r.rank for r in rows) <= 4
    assert all((x.score, y.doc_id) >= (y.score, x.doc_id) for x, y in zip(rows, rows[1:]) if x.query_id == y.query_id)
    described = indexed.describe()
    assert described.get("method") or described.get("model")
    with pytest.raises(ValueError, match="empty"):
        made.index(woods(spark).where("doc_id = 'none'"))


def test_dense_takes_the_best_chunk(spark):
    v = vectors.VocabularyEncoder(tuple(TREES))
    texts = corpus_of(spark, {"m": "oak oak birch birch cedar cedar", "n": "cedar birch cedar"})
    dense = retrievers.DenseRetriever(v, 2).index(texts)
    assert scores(dense.retrieve(asked(spark, q="cedar"))) == {("q", "m"): 1.0, ("q", "n"): 1.0}
    assert dense.describe()["num_chunks"] == 5
    whole = scores(retrievers.DenseRetriever(v).index(texts).retrieve(asked(spark, q="cedar")))
    assert whole["q", "n"] > whole["q", "m"] == pytest.approx(1 / math.sqrt(3), abs=1e-6)
    assert retrievers.DenseRetriever(v, 2, max_tokens=2).index(texts).describe()["truncation_rate"] == pytest.approx(0.8)


def test_a_document_without_tokens_is_refused(spark):
    with pytest.raises(ValueError, match="no token is left of document s"):
        retrievers.LateInteractionRetriever(vectors.VocabularyEncoder(tuple(TREES))).index(corpus_of(spark, {"r": "oak", "s": "granite"}))


def test_expanded_sides(spark):
    made = spark.createDataFrame([("a", ["larch larch"])], "id string, generations array<string>")
    texts = corpus_of(spark, {"r": "oak", "s": "larch"})
    plain = BM25Retriever(tokenizer=PLAIN)
    assert {d for _, d in scores(retrievers.ExpandedRetriever(plain, queries=made, weight=0).index(texts).retrieve(asked(spark, a="oak")))} == {"s"}
    assert {d for _, d in scores(retrievers.ExpandedRetriever(plain, queries=made).index(texts).retrieve(asked(spark, a="oak")))} == {"r", "s"}
    grown = retrievers.ExpandedRetriever(plain, documents=made.withColumn("id", F.lit("r")), settings={"model": "m"}).index(texts)
    assert {d for _, d in scores(grown.retrieve(asked(spark, a="larch")))} == {"r", "s"} and grown.describe()["generation"] == {"model": "m"}


# ---- fusion, reranking, routing


def test_fusion(spark):
    a, b = run_of(spark, [("q", "x", 9), ("q", "y", 8), ("q", "z", 7)]), run_of(spark, [("q", "z", 0.3), ("q", "x", 0.2), ("p", "w", 1)])
    fused = scores(combine.reciprocal_rank_fusion([a, b], 10, weights=[2, 1]))
    assert fused == pytest.approx({("q", "x"): 2 / 11 + 1 / 12, ("q", "y"): 2 / 12, ("q", "z"): 2 / 13 + 1 / 11, ("p", "w"): 1 / 11}, abs=1e-8)
    assert set(scores(combine.reciprocal_rank_fusion([a, b], weights=[0, 1]))) == {("q", "z"), ("q", "x"), ("p", "w")}
    ties = combine.reciprocal_rank_fusion([run_of(spark, [("q", "k", 1)]), run_of(spark, [("q", "j", 1)])]).orderBy("rank").collect()
    assert [r.doc_id for r in ties] == ["j", "k"]
    for bad in ({"runs": []}, {"runs": [a], "k": -0.5}, {"runs": [a], "top": 0}, {"runs": [a], "weights": [1.0, 1.0]}):
        with pytest.raises(ValueError):
            combine.reciprocal_rank_fusion(**bad)


def test_reranked_heads_stay_above_their_tails(spark):
    texts = corpus_of(spark, {"s": "birch", "t": "birch oak", "u": "oak birch oak", "v": "cedar"})
    run = run_of(spark, [("q", "v", 40), ("q", "s", 30), ("q", "u", 20), ("q", "t", 10)])
    oaks = F.size(F.split("text", "oak")) - 1
    order = lambda depth: [r.doc_id for r in combine.rerank(run, asked(spark, q="oak"), texts, oaks, depth).orderBy("rank").collect()]
    assert [order(4), order(3), order(1)] == [["u", "t", "s", "v"], ["u", "s", "v", "t"], ["v", "s", "u", "t"]]
    with pytest.raises(ValueError):
        order(0)


def test_routes(spark):
    stats = spark.createDataFrame([("m", 0.5), ("n", 2.5), ("o", 3.5)], "query_id string, p double")
    assigned = combine.threshold_assignment(stats, "p", 2.5, "hi", "lo")
    assert {r.query_id: r.system for r in assigned.collect()} == {"m": "lo", "n": "hi", "o": "hi"}
    hi, lo = run_of(spark, [("n", "1", 1), ("o", "2", 1), ("m", "9", 1)]), run_of(spark, [("m", "3", 2), ("n", "9", 1)])
    assert set(scores(combine.route({"hi": hi, "lo": lo}, assigned))) == {("m", "3"), ("n", "1"), ("o", "2")}
    with pytest.raises(KeyError, match="o"):
        combine.route({"hi": hi.where("query_id <> 'o'"), "lo": lo}, assigned)
    with pytest.raises(ValueError, match="hi"):
        combine.route({"lo": lo}, assigned)
    values = spark.createDataFrame([("m", "z", 0.5), ("m", "y", 0.5), ("n", "z", 0.25), ("n", "y", 0.75)], "query_id string, system string, value double")
    assert {(r.query_id, r.system) for r in combine.oracle_assignment(values).collect()} == {("m", "y"), ("n", "y")}
    with pytest.raises(ValueError, match="queries"):
        combine.oracle_assignment(values.where("not (query_id = 'n' and system = 'z')"))


# ---- measures and sweeps


def test_measures(spark):
    """Grades 3, 1 and 2 in the places 2, 3 and none: sums of gains by hand."""
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "c", 2), ("q", "d", 0), ("q", "e", -2), ("r", "a", 1)], "query_id string, doc_id string, grade int")
    run = run_of(spark, [("q", "e", 4), ("q", "a", 3), ("q", "b", 2)])
    rows = {(r.query_id, r.gain, r.metric): r.value for r in metrics.evaluate_per_query(run, qrels, (2, 3), metrics.GAINS).collect()}
    place = lambda n: 1 / math.log2(n + 1)
    assert rows["q", "exponential", "ndcg@3"] == pytest.approx((7 * place(2) + place(3)) / (7 + 3 * place(2) + place(3)))
    assert rows["q", "linear", "ndcg@2"] == pytest.approx(3 * place(2) / (3 + 2 * place(2)))
    assert rows["q", "linear", "recall@2"] == pytest.approx(1 / 3) and rows["q", "linear", "recall@3"] == pytest.approx(2 / 3)
    assert {v for (q, _, _), v in rows.items() if q == "r"} == {0.0}
    means = {(r.gain, r.metric): (r.value, r.num_queries) for r in metrics.evaluate(run, qrels, (3,)).collect()}
    assert means["exponential", "ndcg@3"] == (pytest.approx(rows["q", "exponential", "ndcg@3"] / 2), 2)
    assert metrics.oracle_recall(qrels, 2).first()[0] == pytest.approx((2 / 3 + 1) / 2)
    with pytest.raises(ValueError):
        metrics.evaluate(run, qrels, (0,))
    with pytest.raises(ValueError):
        metrics.oracle_recall(qrels.where("grade < 0"), 3)


def test_contained(spark):
    """Documents with six tenths of a query's terms, whatever is frequent."""
    from irspan.sources import fixtures

    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs = {f"d{i}": sorted(set(r.choices(words, weights=range(1, 41), k=r.randrange(0, 30)))) for i in range(80)}
    asked = {f"q{i}": sorted(set(r.choices(words, weights=range(1, 41), k=r.randrange(0, 14)))) for i in range(25)}
    asked["none"] = ["nowhere", "w1"]
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} string, terms array<string>")
    want = {(q, d) for q, t in asked.items() for d, u in docs.items() if t and len(set(t) & set(u)) * 10 >= 6 * len(t)}
    assert {tuple(x) for x in fixtures.contained(frame(docs, "doc_id"), frame(asked, "query_id")).collect()} == want and len(want) > 20


def judged(spark, n=20):
    r = random.Random(4)
    return spark.createDataFrame([(q, f"w{i:02}", r.randrange(3)) for q in "abc" for i in r.sample(range(n), 9)], "query_id string, doc_id string, grade int")


def ndcg(run, qrels):
    return metrics.evaluate(run, qrels, (10,)).where("metric = 'ndcg@10'").first().value


def test_sweeps_are_single_runs(spark, monkeypatch):
    """Every cell of every sweep equals a run with the cell's settings; postings are multiplied a few at a time."""
    monkeypatch.setattr(impacts, "PRODUCTS", 6)
    texts, q, qrels = woods(spark), asked(spark, a="oak cedar", b="larch birch birch", c="willow"), judged(spark)
    r = BM25Retriever(tokenizer=PLAIN).index(texts)
    for c in sweeps.sweep_bm25(r, q, qrels, [(0.9, 0.4), (2.0, 1.0), (0.2, 0.0)]).collect():
        assert c.ndcg == pytest.approx(ndcg(r.with_parameters(c.k1, c.b).retrieve(q, 10), qrels), abs=1e-9)
    f = RM3Retriever(tokenizer=PLAIN).index(texts)
    for c in sweeps.sweep_rm3(f, q, qrels, [(3, 2, 0.5), (5, 2, 0.5), (5, 6, 0.8), (3, 6, 0.0)]).collect():
        assert c.ndcg == pytest.approx(ndcg(f.with_parameters(c.fb_docs, c.fb_terms, c.alpha).retrieve(q, 10), qrels), abs=1e-9)
    made = spark.createDataFrame([("a", ["maple maple oak"]), ("b", ["  "])], "id string, generations array<string>")
    passages = made.select(F.col("id").alias("query_id"), F.get("generations", F.lit(0)).alias("text"))
    monkeypatch.setattr(impacts, "CELL_WEIGHTS", 8)  # in parts
    for c in sweeps.sweep_expansion(r, q, passages, qrels, (0, 2, 5)).collect():
        assert c.ndcg == pytest.approx(ndcg(r.retrieve(expansion.expand_queries(q, made, c.weight), 10), qrels), abs=1e-9)
    runs = [r.retrieve(q, 8), f.retrieve(q, 8)]
    for c in sweeps.sweep_rrf(runs, qrels, (0, 60)).collect():
        assert c.ndcg == pytest.approx(ndcg(combine.reciprocal_rank_fusion(runs, c.rrf_k, 10), qrels), abs=1e-9)


def test_grids_and_their_summaries(spark):
    assert len(sweeps.bm25_grid()) == 121 and (0.9, 0.4) in sweeps.bm25_grid() and len(sweeps.rm3_grid()) == 96
    cells = spark.createDataFrame([(0, 1.0, 0.30), (1, 2.0, 0.42), (2, 3.0, 0.42), (3, 3.0, 0.414)], "cell int, x double, ndcg double")
    assert sweeps.best_cell(cells).first().cell == 1
    assert {r.x: r.cell for r in sweeps.best_by_axis(cells, "x").collect()} == {1.0: 0, 2.0: 1, 3.0: 2}
    s = sweeps.surface(cells).first()
    assert (s.best, s.worst, s.span, s.cells, s.within_005, s.within_010) == (0.42, 0.3, pytest.approx(0.12), 4, 2, 3)
    shape = lambda *v: tuple(sweeps.shape(spark.createDataFrame(list(enumerate(v)), "x int, value double")).first())
    assert shape(0.1, 0.2, 0.3) == (2, True, "increasing") and shape(0.1, 0.4, 0.2) == (1, False, "neither") and shape(0.5, 0.4) == (0, True, "decreasing")


def test_ties_and_long_documents_are_compared_in_bounds(spark, monkeypatch):
    """Of documents that tie, a batch sends on no more than are wanted; no product is larger than its bound."""
    monkeypatch.setattr(vectors, "BLOCK_SCORES", 512)
    largest, most = [], vectors._most
    ids = [f"d{i:03}" for i in range(200)]
    found = vectors._best(np.round(np.ones((3, 200)), 6), ids, ["a", "b", "c"], 4)
    assert found.num_rows == 12 and set(found.column(1).to_pylist()) == set(ids[:4])
    r = np.random.default_rng(5)
    q, d, lengths = r.standard_normal((4, 3)), r.standard_normal((900, 3)), np.array([1, 600, 2, 97, 200])
    want = np.maximum.reduceat(q @ d.T, np.cumsum(lengths) - lengths, axis=1)
    monkeypatch.setattr(vectors, "_most", lambda a, b, n: largest.append(len(a) * len(b)) or most(a, b, n))
    np.testing.assert_allclose(vectors._most(q, d, lengths), want)
    assert min(largest) <= 512
    rows = spark.createDataFrame([(i, p, [1.0, 0.0]) for i in ids for p in range(3)], "doc_id string, pos int, embedding array<double>")
    asked = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [2.0, 0.0])], "query_id string, pos int, embedding array<double>")
    for made in (rows, rows.repartition(4, "pos")):  # together, and a document in several parts
        got = vectors.maxsim_retrieve(asked, made, 5)
        assert [(x.doc_id, x.score) for x in got.orderBy("rank").collect()] == [(i, 3.0) for i in ids[:5]]


def test_judgements_compare_documents_where_they_are(spark, monkeypatch):
    """No meeting of a document and a query is moved, whatever the parts of the queries and the bound of a task."""
    from irspan.sources import fixtures

    docs = {f"{i}": " ".join(f"w{j}" for j in range(i % 9)) for i in range(60)}
    asked = {f"{i}": " ".join(f"w{j}" for j in range(i)) for i in range(8)}
    texts = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    words = spark.createDataFrame([(q, t.split(), t) for q, t in asked.items()], "query_id string, terms array<string>, text string")
    want = {(q, d, t in b) for q, t in asked.items() for d, b in docs.items() if t and len(set(t.split()) & set(b.split())) * 10 >= 6 * len(t.split())}
    for part, meetings in ((100_000, 1 << 21), (6, 4)):
        monkeypatch.setattr(fixtures, "BROADCAST_ROWS", part)
        monkeypatch.setattr(fixtures, "MEETINGS", meetings)
        found = fixtures._close(texts.select("doc_id", texts.text.alias("terms"), "text"), words)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == want and len(want) > 100


def test_a_task_sends_on_as_many_documents_as_are_asked_for(spark, monkeypatch):
    """However many batches a task compares; chunks of a document in different batches count once, with the best one."""
    r = np.random.default_rng(8)
    rows = [(f"d{i // 3:04}", r.standard_normal(4).round(1).tolist()) for i in range(3000)]
    asked = [(f"q{i}", r.standard_normal(4).tolist()) for i in range(5)]
    best = vectors._Best([q for q, _ in asked], 7)
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    scores = {q: {} for q, _ in asked}
    for (d, v), (q, w) in ((x, y) for x in rows for y in asked):
        scores[q][d] = max(scores[q].get(d, -2), round(float(unit(v) @ unit(w)), 6))
    monkeypatch.setattr(vectors, "WAITING_ROWS", 0)  # cut often
    out = []
    for a in range(0, 3000, 100):  # batches that cut documents
        docs = sorted({d for d, _ in rows[a : a + 100]})
        block = np.array([[max(round(float(unit(v) @ unit(w)), 6) for e, v in rows[a : a + 100] if e == d) for d in docs] for _, w in asked])
        out += list(best.add(block, docs, 0))
        assert not out and best.rows <= 3 * 5 * 7
    out += list(best.rest())
    found = sorted((x["query_id"], -x["score"], x["doc_id"]) for b in out for x in b.to_pylist())
    assert found == sorted((q, -s, d) for q, of in scores.items() for s, d in [(-x, d) for x, d in sorted((-s, d) for d, s in of.items())[:7]])
    frame = spark.createDataFrame(rows, "doc_id string, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    want = vectors.dense_retrieve(queries, frame, 7).collect()
    assert sorted((x.query_id, -x.score, x.doc_id) for x in want) == found
    monkeypatch.setattr(vectors, "KEPT_ROWS", 0)  # blocks are sent on as they come
    assert sorted(map(tuple, vectors.dense_retrieve(queries, frame, 7).collect())) == sorted(map(tuple, want))
