"""A changing index against one built whole of what is left."""

import random

import pytest

from irspan.functions.text import PLAIN, Tokenizer
from irspan.operators import segments
from irspan.operators.bm25 import BM25Retriever

WORDS = "loom shuttle weft warp heddle treadle bobbin spindle".split()


def texts(seed, ids):
    r = random.Random(seed)
    return {i: (r.choice([None, "", " ".join(r.choices(WORDS, k=2))]), " ".join(r.choices(WORDS, weights=range(1, 9), k=r.randrange(12)))) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(i, *x) for i, x in rows.items()], "doc_id string, title string, text string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def run(retriever, queries, k=6):
    return sorted(map(tuple, retriever.retrieve(queries, k).collect()))


@pytest.mark.parametrize("fields", [None, ("title", "text")])
@pytest.mark.parametrize("most", [1000, 3])
def test_changes_equal_a_whole_index(spark, monkeypatch, fields, most):
    """Added, replaced and deleted documents, whether struck by name or written out."""
    monkeypatch.setattr(segments, "MOST_STRUCK", most)
    queries = spark.createDataFrame([("a", "weft warp"), ("b", "bobbin bobbin loom"), ("c", "anvil"), ("d", "spindle")], "query_id string, text string")
    whole = lambda rows: BM25Retriever(tokenizer=PLAIN, fields=fields).index(frame(spark, rows))
    left = texts(1, [f"d{i:02}" for i in range(30)])
    changing = segments.SegmentedBM25(tokenizer=PLAIN, fields=fields).index(frame(spark, left))
    assert run(changing, queries) == run(whole(left), queries)
    more = texts(2, [f"d{i:02}" for i in range(20, 45)])  # ten of them are there already
    left |= more
    changing = changing.add(frame(spark, more)).delete(ids(spark, ["d03", "d04", "d25", "d44", "no such"]))
    for gone in ("d03", "d04", "d25", "d44"):
        left.pop(gone)
    want = run(whole(left), queries)
    assert run(changing, queries) == want and len(changing.segments) == 2
    assert all(s.n_struck <= most for s in changing.segments)
    one = changing.compact()
    assert run(one, queries) == want and one.describe()["segments"] == 1 and one.describe()["struck"] == 0
    indexed = whole(left).indexed
    stats = lambda df: sorted((r.field, r.term, r.df, round(r.idf, 9)) for r in df.collect())
    assert stats(changing.statistics[1]) == stats(indexed.terms) == stats(one.statistics[1])


def test_what_a_changing_index_refuses(spark):
    two = {"x": ("", "loom"), "y": ("", "weft")}
    changing = segments.SegmentedBM25(tokenizer=Tokenizer()).index(frame(spark, two))
    with pytest.raises(ValueError, match="twice"):
        changing.add(frame(spark, {"z": ("", "a")}).unionByName(frame(spark, {"z": ("", "b")})))
    with pytest.raises(ValueError, match="nothing is left"):
        changing.delete(ids(spark, ["x", "y"]))
    assert changing.delete(ids(spark, ["q"])).describe()["struck"] == 0
    with pytest.raises(RuntimeError, match="first"):
        segments.SegmentedBM25().retrieve(ids(spark, []))
