"""Pseudo-relevance feedback (RM3): a relevance model from the best documents, mixed into the query."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from irspan.functions.text import Tokenizer
from irspan.operators.bm25 import BM25Retriever, LexicalIndex, query_terms
from irspan.operators.physical import scratch, small, temporary

#: Decimals of a term's weight when terms are ranked.
DECIMALS = 10


@dataclass(frozen=True)
class RM3Retriever:
    """First pass, feedback and second pass with BM25; terms come from title and text as one."""

    fb_docs: int = 10
    fb_terms: int = 10
    alpha: float = 0.5
    k1: float = 0.9
    b: float = 0.4
    tokenizer: Tokenizer = field(default_factory=Tokenizer)
    multi_field: bool = False
    scorer: BM25Retriever | None = None
    harvested: LexicalIndex | None = None

    def __post_init__(self) -> None:
        if self.fb_docs < 0 or self.fb_terms < 0 or not 0 <= self.alpha <= 1:
            raise ValueError("fb_docs and fb_terms must not be negative, and alpha be between 0 and 1")

    def index(self, corpus: DataFrame) -> RM3Retriever:
        scorer = BM25Retriever(self.k1, self.b, self.tokenizer, ("title", "text") if self.multi_field else None).index(corpus)
        harvested = LexicalIndex.build(corpus, self.tokenizer) if self.multi_field else scorer.indexed
        return replace(self, scorer=scorer, harvested=harvested)

    def with_parameters(self, fb_docs: int | None = None, fb_terms: int | None = None, alpha: float | None = None) -> RM3Retriever:
        given = {k: v for k, v in (("fb_docs", fb_docs), ("fb_terms", fb_terms), ("alpha", alpha)) if v is not None}
        return replace(self, **given)

    def relevance_model(self, feedback: DataFrame) -> DataFrame:
        """query_id, term and weight from a run of feedback documents (query_id, doc_id, score)."""
        return self.best_terms(self.feedback_terms(feedback))

    def _need_index(self) -> RM3Retriever:
        if self.scorer is None or self.harvested is None:
            raise RuntimeError("index() comes first")
        return self

    def feedback_terms(self, feedback: DataFrame) -> DataFrame:
        """query_id, term and weight of all terms of the feedback documents."""
        query = Window.partitionBy("query_id")
        shares = feedback.withColumn("share", F.try_divide("score", F.sum("score").over(query))).select("query_id", "doc_id", "share")
        index = self._need_index().harvested
        found = index.documents.join(small(shares, feedback.count()), "doc_id")  # whole documents: few are opened
        return index.postings(found).groupBy("query_id", "term").agg(F.round(F.sum(F.col("share") * F.col("tf") / F.col("dl")), DECIMALS).alias("weight")).where("weight > 0")

    def best_terms(self, model: DataFrame) -> DataFrame:
        """The ``fb_terms`` heaviest terms of each query, their weights summing to 1."""
        query = Window.partitionBy("query_id")
        best = model.withColumn("nth", F.row_number().over(query.orderBy(F.desc("weight"), "term"))).where(F.col("nth") <= self.fb_terms)
        return best.select("query_id", "term", (F.col("weight") / F.sum("weight").over(query)).alias("weight"))

    def expanded_queries(self, queries: DataFrame) -> DataFrame:
        """query_id, term and weight of the mixed queries; without a model a query stays as it is."""
        terms = query_terms(queries, self.tokenizer)
        own = terms.select("query_id", "term", (F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))).alias("weight"))
        if not self.alpha or not self.fb_docs or not self.fb_terms:
            return own
        # The first pass and its model are small (fb_docs and fb_terms rows a query) and read several times.
        feedback = temporary(self.scorer.best(terms, self.fb_docs), "feedback")
        model = temporary(self.relevance_model(feedback), "model")
        has = model.select("query_id").distinct().withColumn("has", F.lit(True))
        scaled = own.join(has, "query_id", "left").select("query_id", "term", F.when(F.col("has"), (1 - self.alpha) * F.col("weight")).otherwise(F.col("weight")).alias("weight"))
        mixed = scaled.unionByName(model.select("query_id", "term", (self.alpha * F.col("weight")).alias("weight")))
        return mixed.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        with scratch():
            return self._need_index().scorer.best(self.expanded_queries(queries), top_k_)

    def describe(self) -> dict:
        return {"model": "rm3", "fb_docs": self.fb_docs, "fb_terms": self.fb_terms, "alpha": self.alpha, "k1": self.k1, "b": self.b, "multi_field": self.multi_field, "tokenizer": self.tokenizer.describe()}
