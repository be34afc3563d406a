"""Workers that run a model: batches by budget, markers, masks, skipped ids, projection, pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from irspan.operators import combine, encoding
from irspan.operators.retrievers import DenseRetriever, LateInteractionRetriever
from irspan.sources.fixtures import SeededModel


def unit(x):
    return x / np.linalg.norm(x)


class Careful(SeededModel):
    """Looks at what it is given: nothing attended may be padding, and batches keep to their budget."""

    def forward(self, ids, attended):
        assert ids.shape == attended.shape and (ids[attended] != self.pad).all()
        assert ids.size <= 60 or len(ids) == 1
        return super().forward(ids, attended)


def texts(spark):
    rows = [(str(i), " ".join(f"w{j}" for j in range(i * 7 % 23)) + ("." if i % 3 else ", end;"), i) for i in range(40)] + [("n", None, 0), ("e", "", 0)]
    return spark.createDataFrame(rows, "doc_id string, text string, pos int").repartition(3)


def test_budget():
    lengths = [5, 3, 9, 30, 3, 1, 9]
    found = list(encoding.budgeted(lengths, 12))
    assert sorted(i for b in found for i in b) == list(range(7)) and [3] in found
    assert all(len(b) == 1 or max(lengths[i] for i in b) * len(b) <= 12 for b in found)
    assert list(encoding.budgeted([], 5)) == []


def test_documents(spark):
    """Marker in the second place, tokens to the length, punctuation skipped."""
    m = Careful
    e = encoding.LateInteractionEncoder(encoding.Spec(m, "careful", 20, 60), m.projection(), m.query_marker, m.document_marker, skipped=m.skipped)
    own = texts(spark).drop("pos")
    found = {}
    for r in e.encode_tokens(own).collect():
        found.setdefault(r.doc_id, {})[r.pos] = r.embedding
    one = SeededModel()
    for r in own.collect():
        ids = [m.cls, m.document_marker, *one.tokenize([r.text or ""])[0][:17], m.sep]
        want = {i: unit(m.projection() @ one.forward(np.array([[x]]), None)[0, 0]) for i, x in enumerate(ids) if x not in m.skipped}
        assert found[r.doc_id].keys() == want.keys()
        for i, v in want.items():
            np.testing.assert_allclose(found[r.doc_id][i], v, atol=1e-12)
    assert e.encode_tokens(own.where("false")).count() == 0


def test_a_worker_loads_once(monkeypatch):
    made = []
    monkeypatch.setattr(encoding, "_loaded", {})
    a, b = (encoding.Spec(lambda n=n: made.append(n) or SeededModel(), n) for n in "ab")
    assert encoding.model_of(a) is encoding.model_of(a) is not encoding.model_of(b) and made == ["a", "b"]


def test_queries_are_filled_with_masks(spark):
    m = SeededModel
    e = encoding.LateInteractionEncoder(encoding.Spec(m, "seeded", 20), m.projection(), m.query_marker, m.document_marker, query_tokens=8, skipped=m.skipped)
    asked = spark.createDataFrame([("a", "one, two"), ("b", "x " * 30), ("c", None)], "query_id string, text string")
    found = {}
    for r in e.encode_tokens(asked, is_query=True).orderBy("query_id", "pos").collect():
        found.setdefault(r.query_id, []).append(r.embedding)
    assert {k: len(v) for k, v in found.items()} == {"a": 8, "b": 8, "c": 8}
    vector = lambda i: unit(m.projection() @ m().forward(np.array([[i]]), None)[0, 0])
    np.testing.assert_allclose(found["c"], [vector(i) for i in (m.cls, m.query_marker, m.sep, *[m.mask] * 5)], atol=1e-12)
    np.testing.assert_allclose(found["a"][3], vector(6), atol=1e-12)  # a query's punctuation counts


def test_what_an_encoder_refuses(spark):
    spec = encoding.Spec(SeededModel, "seeded", 20)
    with pytest.raises(ValueError, match="no projection"):
        encoding.LateInteractionEncoder(spec, None, 8, 3)
    with pytest.raises(ValueError, match="room"):
        encoding.Spec(SeededModel, "seeded", 2)
    wrong = encoding.LateInteractionEncoder(spec, np.ones((2, 3)), 8, 3)
    with pytest.raises(Exception, match="the projection takes 3 numbers, the model gives 8"):
        wrong.encode_tokens(texts(spark)).collect()


def test_retrieval_with_a_model(spark):
    """Dense, late-interaction and reranking retrievers over the harness find the text itself first."""
    corpus = spark.createDataFrame([(f"d{i}", "", f"alpha{i} beta{i} gamma{i}") for i in range(12)], "doc_id string, title string, text string")
    asked = corpus.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), "text")
    spec = encoding.Spec(SeededModel, "seeded", 20)
    late = encoding.LateInteractionEncoder(spec, SeededModel.projection(), 3, 3, query_tokens=6)
    for r in (DenseRetriever(encoding.MeanEncoder(spec)), LateInteractionRetriever(late)):
        run = r.index(corpus).retrieve(asked, 3)
        assert {x.query_id: x.doc_id for x in run.where("rank = 1").collect()} == {f"qd{i}": f"d{i}" for i in range(12)}
    first = run.select("query_id", "doc_id", "score")
    scored = combine.rerank(first, asked, corpus, encoding.PairScorer(spec).score, 2).collect()
    model = SeededModel()
    assert all(x.score == pytest.approx(round(model.forward(np.array([[model.cls]]), None)[0, 0, 0], 6)) for x in scored if x.rank <= 2) and len(scored) == 36


def test_a_real_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    tokens = encoding.VocabularyFile(P.path("word_bpe_49k.json"))
    ids = tokens(["Hello there", "", "<|endoftext|>"])
    assert len(ids[0]) == 2 and ids[1] == [] and 49407 not in ids[2]
