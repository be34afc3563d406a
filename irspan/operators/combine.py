"""Combining runs: fusion, reranking, routing, overlap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irspan.functions.text import document_text
from irspan.operators.ranking import reranked, top_k


def reciprocal_rank_fusion(runs: list[DataFrame], k: float = 60, top: int = 100, weights: list[float] | None = None) -> DataFrame:
    """Sum of ``weight / (k + rank)`` over the runs; a run of weight 0 takes no part."""
    if not runs:
        raise ValueError("there must be a run")
    if k < 0 or top <= 0:
        raise ValueError("k must not be negative, and top be positive")
    weights = weights or [1.0] * len(runs)
    if len(weights) != len(runs):
        raise ValueError("there must be a weight for each run")
    parts = [reranked(r.select("query_id", "doc_id", "score"), "nth").select("query_id", "doc_id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("nth"))).alias("part")) for r, w in zip(runs, weights, strict=True) if w]
    if not parts:
        return top_k(runs[0].select("query_id", "doc_id", F.lit(0.0).alias("score")), top)
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return top_k(fused, top, decimals=9)


def rerank(run: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: Column | Callable[[DataFrame], DataFrame], depth: int = 100) -> DataFrame:
    """New scores for the first ``depth`` documents of each query; the rest follow in their order.

    ``scorer`` is an expression over query_text, title and text, or gives a frame of those and ``document`` (both
    in one) the column ``model_score``, as :class:`~irspan.operators.encoding.PairScorer` does.
    """
    if depth <= 0:
        raise ValueError("depth must be positive")
    ranked = reranked(run.select("query_id", "doc_id", "score"), "nth")
    texts = ranked.where(F.col("nth") <= depth).join(corpus.select("doc_id", "title", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    if not isinstance(scorer, Column):
        texts, scorer = scorer(texts.withColumn("document", document_text(F.col("title"), F.col("text")))), F.col("model_score")
    head = texts.select("query_id", "doc_id", "nth", F.round(scorer.cast("double"), 6).alias("new"))
    rows = ranked.join(head.drop("nth"), ["query_id", "doc_id"], "left")
    floor = F.min("new").over(Window.partitionBy("query_id"))
    score = F.when(F.col("nth") <= depth, F.col("new")).otherwise(floor - (F.col("nth") - depth))
    return reranked(rows.select("query_id", "doc_id", score.alias("score")))


def route(runs: dict[str, DataFrame], assignment: DataFrame, validate: bool = True) -> DataFrame:
    """Each query's ranking from the system that ``assignment`` (query_id, system) names."""
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score", F.lit(s).alias("system")) for s, r in runs.items()])
    if validate:
        unknown = assignment.where(~F.col("system").isin(list(runs))).limit(1).collect()
        if unknown:
            raise ValueError(f"no run of system {unknown[0]['system']}")
        lost = assignment.join(rows.select("query_id", "system").distinct(), ["query_id", "system"], "left_anti").limit(1).collect()
        if lost:
            raise KeyError(f"{lost[0]['system']} has no ranking of query {lost[0]['query_id']}")
    return reranked(rows.join(assignment.select("query_id", "system"), ["query_id", "system"]).select("query_id", "doc_id", "score"))


def threshold_assignment(statistics: DataFrame, predictor: str, threshold: float, at_or_above: str, below: str) -> DataFrame:
    """query_id and system by one predictor."""
    return statistics.select("query_id", F.when(F.col(predictor) >= threshold, at_or_above).otherwise(below).alias("system"))


def oracle_assignment(scores: DataFrame, validate: bool = True) -> DataFrame:
    """query_id and its best system, the alphabetically first of equals; ``scores``: query_id, system, value."""
    if validate:
        sizes = scores.groupBy("query_id").agg(F.count_distinct("system").alias("n")).agg(F.min("n"), F.max("n")).first()
        if sizes[0] is None:
            raise ValueError("there must be a system")
        if sizes[0] != sizes[1]:
            raise ValueError("the systems have different queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("value"), "system")
    return scores.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("query_id", "system", "value")


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Documents that two runs share among their first ``k``."""
    both = reranked(a, "nth").where(F.col("nth") <= k).join(reranked(b, "nth").where(F.col("nth") <= k), ["query_id", "doc_id"])
    queries = a.select("query_id").unionByName(b.select("query_id")).distinct()
    return queries.join(both.groupBy("query_id").agg(F.count("*").alias("shared")), "query_id", "left").select("query_id", F.coalesce("shared", F.lit(0)).alias("shared"))
