"""Expansion of queries and documents by generated text, and what it adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irspan.functions.text import NO_STEM, Tokenizer, expanded_document, expanded_query, strip, words


def expand_queries(queries: DataFrame, expansions: DataFrame, weight: int = 1) -> DataFrame:
    """``queries`` with their first generation appended; ``expansions``: id and generations."""
    passages = expansions.select(F.col("id").alias("query_id"), F.get("generations", F.lit(0)).alias("passage"))
    return queries.join(passages, "query_id", "left").select("query_id", expanded_query(F.col("text"), F.col("passage"), weight).alias("text"))


def expand_documents(corpus: DataFrame, expansions: DataFrame, field: str = "text") -> DataFrame:
    """``corpus`` with all generations appended to one field."""
    rows = corpus.join(expansions.select(F.col("id").alias("doc_id"), "generations"), "doc_id", "left")
    return rows.withColumn(field, expanded_document(F.col(field), F.col("generations"))).select(corpus.columns)


def summarise_expansions(originals: DataFrame, expansions: DataFrame, tokenizer: Tokenizer = NO_STEM) -> DataFrame:
    """One row: inputs, empty expansions, those that add nothing, quartiles, mean and range of the generated
    words and of the new terms, and the mean share of new terms; ``originals``: id and text.

    Words are what white space separates, before any tokenizer; an expansion is empty if all its
    generations are blank.  Terms are the tokenizer's.  Without an expansion all figures are 0.
    """
    kept = F.filter(F.transform("generations", lambda g: strip(F.coalesce(g, F.lit("")))), lambda g: g != "")
    generated = F.coalesce(F.array_join(kept, " "), F.lit(""))
    rows = originals.join(expansions, "id", "left").select(F.coalesce("text", F.lit("")).alias("text"), generated.alias("generated"))
    own, more = tokenizer(F.col("text")), F.array_distinct(tokenizer(F.col("generated")))
    rows = rows.select((F.col("generated") != "").alias("made"), F.size(words(F.col("generated"))).alias("words"), F.size(more).alias("terms"), F.size(F.array_except(more, own)).alias("added"))
    of = lambda c: F.when(F.col("made"), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = [F.count("*").alias("inputs"), F.count_if(~F.col("made")).alias("empty"), F.count_if(F.col("made") & (F.col("added") == 0)).alias("adding_nothing")]
    for c in ("words", "added"):
        out += [zero(F.percentile(of(c), F.lit(p))).alias(f"{c}_{n}") for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
        out += [zero(F.round(F.avg(of(c)), 4)).alias(f"{c}_mean"), F.coalesce(F.min(of(c)), F.lit(0)).cast("long").alias(f"{c}_min"), F.coalesce(F.max(of(c)), F.lit(0)).cast("long").alias(f"{c}_max")]
    share = F.when(F.col("made"), F.coalesce(F.try_divide(F.col("added").cast("double"), F.col("terms")), F.lit(0.0)))
    return rows.agg(*out, zero(F.round(F.avg(share), 4)).alias("mean_fraction"))
