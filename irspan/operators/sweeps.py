"""Parameter sweeps: one plan for all cells of a grid.

What no parameter touches (postings, first passes, ranks) is computed once.  Scores of all cells are
columns of a matrix: a shard of documents reads the blocks of the queries' terms, adds up every cell's scores
of a query and a document together, and sends on only the best documents of each cell.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irspan.operators.bm25 import BM25Retriever, query_terms
from irspan.operators.metrics import discount, gain
from irspan.operators.physical import scratch, temporary, written
from irspan.operators.ranking import reranked
from irspan.operators.rm3 import RM3Retriever

# The default grids.
RRF_K = (0, 1, 5, 10, 20, 40, 60, 100, 200)
EXPANSION_WEIGHTS = (0, 1, 2, 3, 5, 8, 12, 20)
RM3_GRID = {"fb_docs": (3, 5, 10, 20), "fb_terms": (5, 10, 20, 50), "alpha": (0.2, 0.3, 0.4, 0.5, 0.6, 0.8)}


def frange(start: float, stop: float, step: float) -> list[float]:
    """Values from start to stop, both included."""
    return [round(start + i * step, 10) for i in range(int(round((stop - start) / step)) + 1)]


def bm25_grid() -> list[tuple[float, float]]:
    """k1 by b, with the default pair on the grid."""
    return [(k1, b) for k1 in sorted({*frange(0.2, 2.0, 0.2), 0.9}) for b in frange(0.0, 1.0, 0.1)]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` (cell, query_id, doc_id, score) with nth, to the ``k`` best of every query in every cell."""
    order = Window.partitionBy("cell", "query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def mean_ndcg(best: DataFrame, qrels: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``cells`` (with the column cell) with their mean nDCG@k over all judged queries.

    The judgements, and the ideal of each query, are read once for all cells.
    """
    relevant = qrels.where("grade > 0").select("query_id", "doc_id", "grade")
    ideal = relevant.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).where(F.col("i") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(gain(F.col("grade")) / discount(F.col("i"))).alias("ideal"))
    n = qrels.agg(F.count_distinct("query_id").alias("n"))
    dcg = best.join(relevant, ["query_id", "doc_id"]).groupBy("cell", "query_id").agg(F.sum(gain(F.col("grade")) / discount(F.col("nth"))).alias("dcg"))
    sums = dcg.join(ideal, "query_id").groupBy("cell").agg(F.sum(F.col("dcg") / F.col("ideal")).alias("s"))
    rows = cells.join(sums, "cell", "left").crossJoin(F.broadcast(n))  # one row
    return rows.select(*cells.columns, F.coalesce(F.try_divide(F.col("s"), F.col("n")), F.lit(0.0)).alias("ndcg"))


def sweep_bm25(retriever: BM25Retriever, queries: DataFrame, qrels: DataFrame, cells: list[tuple[float, float]], k: int = 10) -> DataFrame:
    """cell, k1, b and mean nDCG@k of every cell; postings are matched once for all cells."""
    grid = queries.sparkSession.createDataFrame([(i, float(k1), float(b)) for i, (k1, b) in enumerate(cells)], "cell int, k1 double, b double")
    k1, b = (np.array([c[i] for c in cells], float) for i in (0, 1))
    averages = dict(retriever.indexed.averages)

    def impacts(field: str, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        tf, length = tf[:, None], (dl / averages[field])[:, None]
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))

    with scratch():
        known = retriever.known_terms(query_terms(queries, retriever.tokenizer))
        weights = F.array(F.struct(F.lit(-1).alias("cell"), (F.col("weight") * F.col("idf")).alias("weight")))
        known = temporary(known.select("query_id", "field", "term", weights.alias("weights")), "terms")
        best = retriever.indexed.impacts.best_of_cells(known, impacts, len(cells), k)
    return mean_ndcg(_ranked(best, k), qrels, grid, k)


def _sweep_weights(retriever: BM25Retriever, weights: DataFrame, qrels: DataFrame, cells: DataFrame, n_cells: int, k: int) -> DataFrame:
    """``cells`` with mean nDCG@k when a cell's query terms have the ``weights`` (cell, query_id, term, weight).

    A term's part of a document's score is the same in all cells but for its weight, so postings are read once;
    weights go to the shards as rows of a matrix, a part of the queries at a time.
    """
    impact = retriever.impact()
    with scratch():
        entry = F.struct("cell", "weight")
        rows = weights.groupBy("query_id", "term").agg(F.collect_list(entry).alias("by_cell")).withColumn("weight", F.lit(1.0))  # of a grid's cells
        known = retriever.known_terms(rows, "by_cell")
        scaled = F.transform("by_cell", lambda x: F.struct(x["cell"].alias("cell"), (x["weight"] * F.col("weight") * F.col("idf")).alias("weight")))
        known = temporary(known.select("query_id", "field", "term", scaled.alias("weights")), "terms")
        best = retriever.indexed.impacts.best_of_cells(known, lambda f, x, y: impact(f, x, y)[:, None], n_cells, k)
    return mean_ndcg(_ranked(best, k), qrels, cells, k)


def surface(cells: DataFrame, value: str = "ndcg") -> DataFrame:
    """Best, worst and span of a sweep, and how many cells are within 0.005 and 0.010 of the best."""
    rows = cells.select(F.round(value, 6).alias("v")).withColumn("best", F.max("v").over(Window.partitionBy()))
    return rows.groupBy("best").agg(F.min("v").alias("worst"), F.count("*").alias("cells"), F.count_if(F.col("best") - F.col("v") <= 0.005 + 1e-9).alias("within_005"), F.count_if(F.col("best") - F.col("v") <= 0.010 + 1e-9).alias("within_010")).select("best", "worst", F.round(F.col("best") - F.col("worst"), 6).alias("span"), "cells", "within_005", "within_010")


def best_cell(cells: DataFrame, value: str = "ndcg") -> DataFrame:
    """The best cell, the first of equals."""
    return cells.withColumn("v", F.round(value, 6)).orderBy(F.desc("v"), "cell").limit(1).drop("v")


def shape(points: DataFrame) -> DataFrame:
    """Of a sweep over one axis (x, value): whether the best is at an edge, and the direction."""
    rows = points.withColumn("step", F.col("value") - F.lag("value").over(Window.orderBy("x")))
    edge = rows.agg(F.max_by("x", F.struct("value", -F.col("x"))).alias("best_x"), F.min("x").alias("low"), F.max("x").alias("high"), F.bool_and(F.coalesce(F.col("step") > 0, F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("step") < 0, F.lit(True))).alias("down"))
    return edge.select("best_x", ((F.col("best_x") == F.col("low")) | (F.col("best_x") == F.col("high"))).alias("at_edge"), F.when(F.col("up"), "increasing").when(F.col("down"), "decreasing").otherwise("neither").alias("direction"))


def best_by_axis(cells: DataFrame, axis: str, value: str = "ndcg") -> DataFrame:
    """For each value of one axis its best cell, the first of equals."""
    order = Window.partitionBy(axis).orderBy(F.desc("v"), "cell")
    return cells.withColumn("v", F.round(value, 6)).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("v", "nth")


def _grid(qrels: DataFrame, column: str, values: tuple, kind: str) -> DataFrame:
    return qrels.sparkSession.createDataFrame(list(enumerate(values)), f"cell int, {column} {kind}")


def sweep_rrf(runs: list[DataFrame], qrels: DataFrame, ks: tuple = RRF_K, k: int = 10) -> DataFrame:
    """cell, rrf_k and mean nDCG@k of the fused runs for each constant; runs are ranked once."""
    grid = _grid(qrels, "rrf_k", tuple(float(x) for x in ks), "double")
    ranks = reduce(DataFrame.unionByName, [reranked(r.select("query_id", "doc_id", "score"), "nth").select("query_id", "doc_id", "nth") for r in runs])
    sums: list[Column] = [F.round(F.sum(F.lit(1.0) / (F.lit(float(x)) + F.col("nth"))), 9).alias(f"s{i}") for i, x in enumerate(ks)]
    fused = ranks.groupBy("query_id", "doc_id").agg(*sums)
    cells = fused.select("query_id", "doc_id", F.posexplode(F.array(*(f"s{i}" for i in range(len(ks))))).alias("cell", "score"))
    order = Window.partitionBy("cell", "query_id").orderBy(F.desc("score"), "doc_id")
    best = cells.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return mean_ndcg(best, qrels, grid, k)


def sweep_expansion(retriever: BM25Retriever, queries: DataFrame, passages: DataFrame, qrels: DataFrame, weights: tuple = EXPANSION_WEIGHTS, k: int = 10) -> DataFrame:
    """cell, weight and mean nDCG@k for each weight of the query: its term counts are weighted, not its text
    repeated; a query without a passage stays as it is."""
    grid = _grid(qrels, "weight", tuple(weights), "long")
    own = query_terms(queries, retriever.tokenizer)
    more = written(query_terms(passages, retriever.tokenizer), "passages")
    has = more.select("query_id").distinct().withColumn("has", F.lit(True))
    cells = F.broadcast(grid.select("cell", F.col("weight").alias("times")))
    times = F.when(F.col("has"), F.col("times")).otherwise(F.lit(1))
    weighted = own.join(has, "query_id", "left").crossJoin(cells).select("cell", "query_id", "term", (F.col("weight") * times).alias("weight"))
    both = weighted.unionByName(more.crossJoin(cells).select("cell", "query_id", "term", "weight"))  # the grid is a parameter
    return _sweep_weights(retriever, both.groupBy("cell", "query_id", "term").agg(F.sum("weight").alias("weight")), qrels, grid, len(weights), k)


def rm3_grid() -> list[tuple[int, int, float]]:
    return [(d, t, a) for d in RM3_GRID["fb_docs"] for t in RM3_GRID["fb_terms"] for a in RM3_GRID["alpha"]]


def sweep_rm3(retriever: RM3Retriever, queries: DataFrame, qrels: DataFrame, grid: list[tuple[int, int, float]] | None = None, k: int = 10) -> DataFrame:
    """cell, fb_docs, fb_terms, alpha and mean nDCG@k of every cell.

    The first pass runs once, to the greatest ``fb_docs``; a model for each number of feedback documents
    is ranked once, and its prefixes are the models of fewer terms.
    """
    grid = rm3_grid() if grid is None else grid
    spark = queries.sparkSession
    cells = spark.createDataFrame([(i, *map(int, c[:2]), float(c[2])) for i, c in enumerate(grid)], "cell int, fb_docs int, fb_terms int, alpha double")
    docs, terms_ = (spark.createDataFrame([(x,) for x in sorted({c[i] for c in grid})], f"{n} int") for i, n in ((0, "fb_docs"), (1, "fb_terms")))
    terms = query_terms(queries, retriever.tokenizer)
    own = terms.select("query_id", "term", (F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))).alias("own"))
    first = written(retriever.scorer.best(terms, max(c[0] for c in grid)), "feedback")
    # A number of feedback documents makes a query of its own: "5 q1" is q1 with five of them.
    feedback = first.crossJoin(F.broadcast(docs)).where(F.col("rank") <= F.col("fb_docs")).withColumn("query_id", F.concat_ws(" ", F.col("fb_docs").cast("string"), "query_id"))
    model = retriever.feedback_terms(written(feedback.select("query_id", "doc_id", "score"), "feedback"))
    ranked = model.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))).where(F.col("nth") <= max(c[1] for c in grid))
    cut = ranked.crossJoin(F.broadcast(terms_)).where(F.col("nth") <= F.col("fb_terms"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id", "fb_terms"))
    models = cut.select(F.substring_index("query_id", " ", 1).cast("int").alias("fb_docs"), F.expr("substring(query_id, instr(query_id, ' ') + 1)").alias("query_id"), "fb_terms", "term", share.alias("share"))
    models = written(models, "models")
    has = models.select("query_id", "fb_docs", "fb_terms").distinct().withColumn("has", F.lit(True))
    alpha = F.when(F.col("has"), F.col("alpha")).otherwise(F.lit(0.0))
    mixed = own.crossJoin(F.broadcast(cells)).join(has, ["query_id", "fb_docs", "fb_terms"], "left").select("cell", "query_id", "term", ((1 - alpha) * F.col("own")).alias("weight"))
    mixed = mixed.unionByName(models.join(F.broadcast(cells), ["fb_docs", "fb_terms"]).select("cell", "query_id", "term", (F.col("alpha") * F.col("share")).alias("weight")))  # the grid is a parameter
    weights = mixed.groupBy("cell", "query_id", "term").agg(F.sum("weight").alias("weight"))
    return _sweep_weights(retriever.scorer, weights, qrels, cells, len(grid), k)


def sweep_router(statistics: DataFrame, scores: DataFrame, predictor: str, at_or_above: str, below: str, steps: int = 20) -> DataFrame:
    """Mean value when queries go to a system by a threshold, at each quantile of the predictor;
    ``scores``: query_id, system, value."""
    quantiles = statistics.agg(F.percentile(predictor, F.array(*(F.lit(i / steps) for i in range(steps + 1)))).alias("q"))
    cells = quantiles.select(F.posexplode("q").alias("cell", "threshold"))
    wide = scores.groupBy("query_id").pivot("system", [at_or_above, below]).agg(F.first("value"))
    rows = statistics.join(wide, "query_id").crossJoin(F.broadcast(cells))  # steps + 1 rows
    chosen = F.when(F.col(predictor) >= F.col("threshold"), F.col(at_or_above)).otherwise(F.col(below))
    return rows.groupBy("cell", "threshold").agg(F.avg(chosen).alias("value"))
