"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before it kept, written as Parquet and read again:
documents in no learned language go, documents of low quality go, one document of each group of
near duplicates stays, repeated passages are taken out, and what is left is packed.

Defined cases: a null or empty text, or one without a letter, is in no language and goes at the first
stage.  Rows with a null id pass the filters like any other; they are in no group of near duplicates, and
their passages count as later than all others'.  Rows that repeat are near duplicates, and one stays; rows
with equal ids and different texts are documents of their own.  An empty table goes through all stages
empty, with the same columns.  Without labels every document passes the quality stage.  Extra columns,
whatever their names, go along to the last stage, which returns places alone.  Very long texts are whole
at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common, knn_quality, language_id, pattern_packing, simhash_dedup, suffix_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones (operator 5)."""
    return language_id.accepted(docs, language_id.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours are good ones (operator 10)."""
    return knn_quality.accepted(docs, knn_quality.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 4): five-word shingles, similarity 0.8 or more."""
    return simhash_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has (operator 8)."""
    return suffix_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences (operator 7)."""
    return pattern_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: SQL has no SimHash, suffix order or tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = common.Table(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = after.rows, after
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
