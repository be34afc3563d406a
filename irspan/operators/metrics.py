"""Measures of rankings against graded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAINS = ("exponential", "linear")

# Published nDCG@10 of the multi-field baseline, and the tolerance of a reproduction.
PUBLISHED_NDCG_10 = {"scifact": 0.665, "nfcorpus": 0.325, "scidocs": 0.158, "trec-covid": 0.656}
TOLERANCE = 0.03
# Published nDCG@10 of learned models, by method.
PUBLISHED_LEARNED = {
    "splade": {"scifact": 0.693, "nfcorpus": 0.348, "trec-covid": 0.727},
    "colbert": {"scifact": 0.693, "nfcorpus": 0.338, "trec-covid": 0.738},
}


def gain(grade: Column, kind: str = "exponential") -> Column:
    """Gain of a grade; grades of 0 and below have none."""
    if kind not in GAINS:
        raise ValueError(f"gain must be one of {GAINS}")
    g = F.greatest(F.coalesce(grade, F.lit(0)), F.lit(0)).cast("double")
    return F.pow(F.lit(2.0), g) - 1 if kind == "exponential" else g


def discount(rank: Column) -> Column:
    return F.log2(rank.cast("double") + 1)


def _check(k_values: tuple[int, ...]) -> tuple[int, ...]:
    if not k_values or min(k_values) <= 0:
        raise ValueError("k must be positive")
    return tuple(sorted(set(k_values)))


def evaluate_per_query(run: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = (10, 100), gains: tuple[str, ...] = ("exponential",)) -> DataFrame:
    """Long rows (query_id, gain, metric, value) of nDCG and recall at each k, for every judged query;
    one that the run lacks scores 0.  One pass over run and judgements for all k and gains."""
    ks = _check(k_values)
    ranked = run.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("nth") <= ks[-1])
    hits = ranked.join(qrels.where("grade > 0"), ["query_id", "doc_id"]).select("query_id", "nth", "grade")
    ideal = qrels.where("grade > 0").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    at = lambda k, x: F.sum(F.when(F.col("nth") <= k, x).otherwise(0.0))
    dcg = hits.groupBy("query_id").agg(*(at(k, gain(F.col("grade"), g) / discount(F.col("nth"))).alias(f"dcg_{g}_{k}") for k in ks for g in gains), *(at(k, F.lit(1.0)).alias(f"found_{k}") for k in ks))
    best = ideal.groupBy("query_id").agg(*(at(k, gain(F.col("grade"), g) / discount(F.col("nth"))).alias(f"ideal_{g}_{k}") for k in ks for g in gains), F.count("*").alias("relevant"))
    rows = qrels.select("query_id").distinct().join(best, "query_id", "left").join(dcg, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    values = [F.struct(F.lit(g).alias("gain"), F.lit(f"ndcg@{k}").alias("metric"), ratio(f"dcg_{g}_{k}", f"ideal_{g}_{k}").alias("value")) for k in ks for g in gains]
    values += [F.struct(F.lit(g).alias("gain"), F.lit(f"recall@{k}").alias("metric"), ratio(f"found_{k}", "relevant").alias("value")) for k in ks for g in gains]
    return rows.select("query_id", F.explode(F.array(*values)).alias("v")).select("query_id", "v.gain", "v.metric", "v.value")


def evaluate(run: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = (10, 100), gains: tuple[str, ...] = ("exponential",)) -> DataFrame:
    """Means over the judged queries: gain, metric, value, num_queries."""
    return macro_mean(evaluate_per_query(run, qrels, k_values, gains))


def macro_mean(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("gain", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("num_queries"))


def oracle_recall(qrels: DataFrame, k: int, validate: bool = True) -> DataFrame:
    """The highest recall that k documents allow: mean of least(k, relevant) over relevant."""
    _check((k,))
    relevant = qrels.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("n"))
    if validate and relevant.limit(1).count() == 0:
        raise ValueError("no query has a relevant document")
    return relevant.agg(F.avg(F.least(F.lit(k), F.col("n")) / F.col("n")).alias("oracle_recall"))


def gain_difference(per_query: DataFrame) -> DataFrame:
    """Exponential less linear mean of each metric."""
    means = macro_mean(per_query).groupBy("metric").pivot("gain", list(GAINS)).agg(F.first("value"))
    return means.select("metric", *GAINS, (F.col("exponential") - F.col("linear")).alias("difference"))


def baseline_verdict(measured: DataFrame) -> DataFrame:
    """dataset and value, with the published value, their difference and whether it is within tolerance."""
    published = measured.sparkSession.createDataFrame(list(PUBLISHED_NDCG_10.items()), "dataset string, published double")
    delta = F.col("value") - F.col("published")
    return measured.join(published, "dataset").select("dataset", "value", "published", delta.alias("delta"), (F.abs(delta) <= TOLERANCE).alias("within"))


def qrels_profile(qrels: DataFrame) -> DataFrame:
    """Judgements, relevant ones, queries, grade levels, and whether more than two are used."""
    return qrels.agg(F.count("*").alias("judgements"), F.count_if(F.col("grade") > 0).alias("relevant"), F.count_distinct("query_id").alias("queries"), F.array_sort(F.collect_set("grade")).alias("levels")).withColumn("graded", F.size(F.filter("levels", lambda g: g > 0)) > 1)


def formulation_spread(means: DataFrame) -> DataFrame:
    """Largest less smallest mean over query formulations (formulation, value)."""
    return means.agg(F.max("value").alias("best"), F.min("value").alias("worst"), (F.max("value") - F.min("value")).alias("spread"))


def formulation_means(values: DataFrame, published: float | None = None) -> DataFrame:
    """Means of every metric for each formulation (formulation, query_id, metric, value), and the difference
    to a published value of nDCG@10 (null elsewhere)."""
    means = values.groupBy("formulation", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("num_queries"))
    delta = F.when(F.col("metric") == "ndcg@10", F.col("value") - F.lit(published).cast("double"))
    return means.withColumn("delta_to_published", delta)
