"""The one place that ranks: by rounded score, then by document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals of a score.  Sums of doubles depend on their order; ranks must not.
DECIMALS = 6


def rounded(score: Column, decimals: int = DECIMALS) -> Column:
    return F.round(score, decimals)


def top_k(scores: DataFrame, k: int, drop_zero: bool = True, decimals: int = DECIMALS) -> DataFrame:
    """The run (query_id, doc_id, score, rank) of the ``k`` best documents of each query.

    ``drop_zero``: lexical and sparse models leave out documents without a positive score.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    run = scores.select("query_id", "doc_id", rounded(F.col("score"), decimals).alias("score"))
    if drop_zero:
        run = run.where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return run.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reranked(run: DataFrame, column: str = "rank") -> DataFrame:
    """``run`` with ranks by its scores."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return run.withColumn(column, F.row_number().over(order))
