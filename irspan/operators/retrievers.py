"""Retrievers: whatever indexes a corpus and answers queries with a run.

Lexical ones are in :mod:`bm25` and :mod:`rm3`; here are those over a model's vectors, and those that
combine others.  Each keeps its settings for the record in ``describe()``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irspan.functions.text import chunks, document_text, truncation_rate
from irspan.operators import combine, expansion, vectors
from irspan.operators.impacts import ImpactIndex
from irspan.operators.physical import written


@runtime_checkable
class Retriever(Protocol):
    """``index`` gives a retriever over a corpus (doc_id, title, text); ``retrieve`` the run (query_id,
    doc_id, score, rank) of the best documents of queries (query_id, text)."""

    def index(self, corpus: DataFrame) -> Retriever: ...

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame: ...

    def describe(self) -> dict: ...


def _texts(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", document_text(F.col("title"), F.col("text")).alias("text"))


def _indexed(table):
    if table is None:
        raise RuntimeError("index() comes first")
    return table


def _some(table: DataFrame) -> DataFrame:
    if not table.limit(1).count():
        raise ValueError("the corpus is empty")
    return table


@dataclass(frozen=True)
class DenseRetriever:
    """Exact nearest neighbours of an encoder's vectors; texts in windows of ``chunk_words`` words, of which
    the best one counts, or whole."""

    encoder: vectors.Encoder
    chunk_words: int | None = None
    chunk_overlap: int = 0
    model: str = "plug-in"
    max_tokens: int | None = None
    embeddings: DataFrame | None = None

    def index(self, corpus: DataFrame) -> DenseRetriever:
        """Encode every chunk once; the vectors are written to the shared folder."""
        rows = _texts(corpus).select("doc_id", F.explode(chunks(F.col("text"), self.chunk_words, self.chunk_overlap)).alias("text"))
        return replace(self, embeddings=_some(written(self.encoder.encode(rows), "embeddings")))

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        found = self.encoder.encode(queries.select("query_id", "text")).select("query_id", "embedding")
        return vectors.dense_retrieve(found, _indexed(self.embeddings).select("doc_id", "embedding"), top_k_)

    def describe(self) -> dict:
        out = {"method": "dense", "model": self.model, "similarity": "cosine", "chunk_words": self.chunk_words, "chunk_overlap": self.chunk_overlap if self.chunk_words else None}
        if self.embeddings is None:
            return out
        rate = None
        if self.max_tokens is not None:
            rate = self.embeddings.agg(truncation_rate(F.split("text", r"\s+"), self.max_tokens).alias("r")).first().r
        return {**out, "num_chunks": self.embeddings.count(), "max_tokens": self.max_tokens, "truncation_rate": rate}


@dataclass(frozen=True)
class SparseRetriever:
    """Dot products of learned term weights: an encoder's vectors by position are logits of a vocabulary."""

    encoder: vectors.TokenEncoder
    top_terms: int | None = None
    model: str = "plug-in"
    postings: DataFrame | None = None
    indexed: ImpactIndex | None = None

    def index(self, corpus: DataFrame) -> SparseRetriever:
        logits = self.encoder.encode_tokens(_texts(_some(corpus)))
        postings = written(vectors.sparse_encode(logits, self.top_terms), "postings")
        return replace(self, postings=postings, indexed=vectors.sparse_index(postings))

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        logits = self.encoder.encode_tokens(queries.select("query_id", "text"), is_query=True)
        return vectors.sparse_retrieve(vectors.sparse_encode(logits, self.top_terms, key="query_id"), _indexed(self.indexed), top_k_)

    def describe(self) -> dict:
        out = {"method": "learned-sparse", "model": self.model, "top_terms": self.top_terms}
        return out if self.postings is None else {**out, "mean_terms_per_document": vectors.mean_terms(self.postings).first().mean_terms}


@dataclass(frozen=True)
class LateInteractionRetriever:
    """Sums of each query token's best match among a document's tokens."""

    encoder: vectors.TokenEncoder
    model: str = "plug-in"
    documents: DataFrame | None = None

    def index(self, corpus: DataFrame) -> LateInteractionRetriever:
        """Encode every token once, a document's vectors in a row; a document of which none is left is an error."""
        texts = _texts(_some(corpus))
        documents = vectors.by_document(self.encoder.encode_tokens(texts))
        lost = texts.select("doc_id").join(documents.select("doc_id"), "doc_id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"no token is left of document {lost[0][0]}")
        return replace(self, documents=documents)

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        asked = self.encoder.encode_tokens(queries.select("query_id", "text"), is_query=True).select("query_id", "pos", "embedding")
        return vectors.maxsim_retrieve(asked, _indexed(self.documents), top_k_)

    def describe(self) -> dict:
        out = {"method": "late-interaction", "model": self.model, "similarity": "maxsim"}
        return out if self.documents is None else {**out, "num_tokens": self.documents.agg(F.sum("n").alias("n")).first().n}


@dataclass(frozen=True)
class FusedRetriever:
    """Reciprocal rank fusion of other retrievers' runs to a depth."""

    retrievers: tuple[Retriever, ...]
    k: float = 60
    weights: tuple[float, ...] | None = None
    depth: int = 100

    def index(self, corpus: DataFrame) -> FusedRetriever:
        return replace(self, retrievers=tuple(r.index(corpus) for r in self.retrievers))

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        runs = [r.retrieve(queries, self.depth) for r in self.retrievers]
        return combine.reciprocal_rank_fusion(runs, self.k, top_k_, list(self.weights) if self.weights else None)

    def describe(self) -> dict:
        return {"method": "rrf", "k": self.k, "weights": self.weights, "depth": self.depth, "retrievers": [r.describe() for r in self.retrievers]}


@dataclass(frozen=True)
class RerankedRetriever:
    """Another retriever's first documents, scored anew by an expression over query_text, title and text."""

    retriever: Retriever
    scorer: Column
    depth: int = 100
    model: str = "plug-in"
    corpus: DataFrame | None = None

    def index(self, corpus: DataFrame) -> RerankedRetriever:
        return replace(self, retriever=self.retriever.index(corpus), corpus=corpus)

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        run = self.retriever.retrieve(queries, max(top_k_, self.depth))
        return combine.rerank(run, queries, _indexed(self.corpus), self.scorer, self.depth).where(F.col("rank") <= top_k_)

    def describe(self) -> dict:
        return {"method": "rerank", "model": self.model, "depth": self.depth, "first_stage": self.retriever.describe()}


@dataclass(frozen=True)
class ExpandedRetriever:
    """Another retriever over queries, or documents, with generated text appended (id, generations)."""

    retriever: Retriever
    queries: DataFrame | None = None
    documents: DataFrame | None = None
    weight: int = 1
    field: str = "text"
    settings: dict | None = None

    def index(self, corpus: DataFrame) -> ExpandedRetriever:
        full = corpus if self.documents is None else expansion.expand_documents(corpus, self.documents, self.field)
        return replace(self, retriever=self.retriever.index(full))

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        full = queries if self.queries is None else expansion.expand_queries(queries, self.queries, self.weight)
        return self.retriever.retrieve(full, top_k_)

    def describe(self) -> dict:
        kind = [k for k, x in (("queries", self.queries), ("documents", self.documents)) if x is not None]
        return {"method": "expanded", "expanded": kind, "query_weight": self.weight if self.queries is not None else None, "generation": self.settings, "retriever": self.retriever.describe()}
