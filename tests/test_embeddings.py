"""A store of embeddings encodes what it has not got."""

import os

import pytest
from pyspark.sql import functions as F

from irspan.sources.embeddings import EmbeddingStore


class Lengths:
    """Encodes a text as its length and a mark; counts what it is given."""

    def __init__(self, mark=0.0, fails=False):
        self.mark, self.fails, self.given = mark, fails, []

    def encode(self, texts, text_column="text"):
        self.given.append(texts.count())
        length = F.length(text_column).cast("double")
        if self.fails:
            length = F.raise_error(F.lit("the model is gone")).cast("double")
        return texts.withColumn("embedding", F.array(length, F.lit(self.mark)))


def texts(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id string, text string")


def test_updates(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path), {"model": "a/b", "max": 3})
    rows = {f"d{i}": "x" * i for i in range(20)} | {"n": None}
    assert store.stored() is None
    first, second, third = Lengths(1.0), Lengths(2.0), Lengths(3.0)
    found = store.update(texts(spark, rows), first).collect()
    assert first.given == [21] and {r.doc_id: r.embedding for r in found} == {i: [float(len(t or "")), 1.0] for i, t in rows.items()}
    assert store.update(texts(spark, rows), second).count() == 21 and second.given == []
    changed = rows | {"d3": "now another", "new": "z"}
    changed.pop("d4")
    found = {r.doc_id: (*r.embedding, r.version) for r in store.update(texts(spark, changed), second).collect()}
    assert second.given == [2] and found["d3"] == (11.0, 2.0, 2) and found["new"] == (1.0, 2.0, 2) and found["d5"] == (5.0, 1.0, 1) and "d4" not in found and len(found) == 21
    assert {r.doc_id: r.embedding[1] for r in store.update(texts(spark, rows), third).collect()}["d3"] == 1.0 and third.given == []  # its former text
    store.compact(texts(spark, changed))
    assert store.stored().count() == 21 and len([x for x in os.listdir(store.path) if x.startswith("part-")]) == 1
    assert {r.doc_id: (*r.embedding, r.version) for r in store.update(texts(spark, changed), third).collect()} == found and third.given == []
    other = EmbeddingStore(spark, str(tmp_path), {"model": "a/b", "max": 4})
    assert other.stored() is None and other.update(texts(spark, {}), third).count() == 0


def test_a_failed_update_changes_nothing(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path), {"model": "m"})
    store.update(texts(spark, {"a": "x"}), Lengths())
    with pytest.raises(Exception, match="the model is gone"):
        store.update(texts(spark, {"a": "x", "b": "yy"}), Lengths(fails=True))
    assert [r.doc_id for r in store.stored().collect()] == ["a"]
    again = Lengths()
    assert store.update(texts(spark, {"a": "x", "b": "yy", "c": "yy"}).union(texts(spark, {"c": "yy"})), again).count() == 3 and again.given == [2]
