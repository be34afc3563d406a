"""Agreement of a judge with human grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irspan.functions.text import verdict
from irspan.operators.physical import cumulative, written
from irspan.operators.ranking import reranked

def confusion(pairs: DataFrame) -> DataFrame:
    """first, second and n for every pair of the labels that either column uses."""
    cells = written(pairs.groupBy("first", "second").agg(F.count("*").alias("n")), "cells")
    labels = cells.select(F.explode(F.array("first", "second")).alias("label")).agg(F.collect_set("label").alias("labels"))  # a row of labels
    square = labels.select("labels", F.explode("labels").alias("first")).select("first", F.explode("labels").alias("second"))
    return square.join(cells, ["first", "second"], "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n"))


def kappa(pairs: DataFrame, validate: bool = True) -> DataFrame:
    """Observed and chance agreement and Cohen's kappa (0 where chance agreement is whole); one row.
    No items is an error."""
    cells = pairs.groupBy("first", "second").agg(F.count("*").alias("n"))
    if validate:
        cells = written(cells, "cells")
        if not cells.limit(1).count():
            raise ValueError("there are no items to agree on")
    first = cells.groupBy(F.col("first").alias("label")).agg(F.sum("n").alias("x"))
    second = cells.groupBy(F.col("second").alias("label")).agg(F.sum("n").alias("y"))
    chance = first.join(second, "label", "left").agg(F.coalesce(F.sum(F.col("x") * F.coalesce("y", F.lit(0))), F.lit(0)).alias("products"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("same"))
    po, pc = F.col("same") / F.col("n"), F.col("products") / (F.col("n") * F.col("n"))
    rows = whole.crossJoin(chance).select("n", po.alias("observed"), pc.alias("chance"))  # a row each
    return rows.select("n", "observed", "chance", F.when(F.col("chance") >= 1, 0.0).otherwise(F.try_divide(F.col("observed") - F.col("chance"), 1 - F.col("chance"))).alias("kappa"))


def judgeable_pairs(qrels: DataFrame, run: DataFrame | None = None, depth: int = 10, source: str = "qrels", min_per_class: int = 30, validate: bool = True) -> DataFrame:
    """query_id, doc_id and grade of all judgements, or of those among a run's first ``depth``.

    An error where there is no pair that isn't relevant, or fewer than ``min_per_class`` of either class.
    """
    if source not in ("qrels", "retrieved"):
        raise ValueError("source must be qrels or retrieved")
    if source == "retrieved" and run is None:
        raise ValueError("a run is needed")
    rows = qrels.select("query_id", "doc_id", "grade")
    if source == "retrieved":
        rows = reranked(run.select("query_id", "doc_id", "score"), "nth").where(F.col("nth") <= depth).select("query_id", "doc_id").join(rows, ["query_id", "doc_id"])
    if source == "qrels" and validate and not rows.where("grade <= 0").limit(1).count():
        raise ValueError("the judgements have no document that isn't relevant, so a judge that always says yes would be right")
    if validate and min_per_class:
        positive, negative = rows.agg(F.count_if(F.col("grade") > 0), F.count_if(F.col("grade") <= 0)).first()
        if min(positive, negative) < min_per_class:
            raise ValueError(f"{positive} relevant and {negative} other pairs: {min_per_class} of each are needed")
    return rows


def thinned(pairs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` pairs at even steps, in the order of query and document."""
    n = pairs.count()
    if n <= most:
        return pairs
    rows = cumulative(pairs, ["query_id", "doc_id"], F.lit(1), "at").withColumn("at", F.col("at") - 1)
    wanted = pairs.sparkSession.range(most).select(F.floor(F.col("id") * (n / most)).alias("at"))
    return rows.join(wanted, "at", "left_semi").drop("at")


def calibrated(judged: DataFrame, answer: Column | str = "answer", validate: bool = True) -> DataFrame:
    """Kappa of parsed answers against grade > 0, with unparseable answers counted and left out, false
    positives and negatives, and the judge's share of yes; ``judged``: grade and an answer.  No answer that
    can be read is an error."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    rows = judged.select((F.col("grade") > 0).cast("int").alias("first"), verdict(answer).alias("second"))
    counts = rows.agg(F.count_if(F.col("second").isNull()).alias("unparseable"), F.count_if((F.col("first") == 0) & (F.col("second") == 1)).alias("false_positives"), F.count_if((F.col("first") == 1) & (F.col("second") == 0)).alias("false_negatives"), F.avg("second").alias("yes_rate"))
    known = rows.where("second is not null")
    if validate and not known.limit(1).count():
        raise ValueError("no answer of the judge can be read as yes or no")
    return kappa(known, validate=False).crossJoin(counts)  # a row each
