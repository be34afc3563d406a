"""Search over an indexed dataset: the tools that a caller uses, as DataFrames and plain dictionaries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irspan.functions.text import NO_STEM, Tokenizer, source_block
from irspan.operators import generation
from irspan.operators.bm25 import BM25Retriever, MultiFieldBM25Retriever
from irspan.operators.combine import overlap, reciprocal_rank_fusion
from irspan.operators.metrics import PUBLISHED_NDCG_10
from irspan.operators.ranking import reranked
from irspan.operators.retrievers import DenseRetriever
from irspan.operators.vectors import Encoder

#: Documents that either model gives to the fusion (more where more results are asked for), and its constant.
DEPTH, FUSION_K = 100, 5
SNIPPET_CHARS = 600
CAVEAT = "Only scores of judged queries with these settings are benchmark results: a query that was made up has no judgements."


def result_rows(run: DataFrame, corpus: DataFrame) -> DataFrame:
    """A run with titles and snippets: query_id, doc_id, score, title, snippet, rank."""
    rows = run.join(corpus.select("doc_id", "title", "text"), "doc_id")
    return rows.select("query_id", "doc_id", F.round("score", 4).alias("score"), "title", F.substring("text", 1, SNIPPET_CHARS).alias("snippet"), "rank")


def format_sources(run: DataFrame, corpus: DataFrame, max_chars: int = 700) -> DataFrame:
    """query_id and the numbered sources of a prompt; a document that isn't there is an empty block."""
    rows = reranked(run.select("query_id", "doc_id", "score"), "nth").join(corpus.select("doc_id", "title", "text"), "doc_id", "left")
    block = source_block(F.col("nth"), F.col("title"), F.col("text"), max_chars)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("sources"))  # of a run's depth


def describe_benchmark(corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: documents, judged queries, judgements, relevant ones."""
    counts = qrels.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("judgements"), F.count_if(F.col("grade") > 0).alias("relevant"))
    return corpus.agg(F.count("*").alias("documents")).crossJoin(counts)  # a row each


class SearchService:
    """Search with BM25, an encoder's vectors where one is given, and both fused.

    Indexes are written when first needed, and read by every call after that.
    """

    def __init__(self, name: str, corpus: DataFrame, qrels: DataFrame | None = None, encoder: Encoder | None = None, tokenizer: Tokenizer = NO_STEM, split: str = "test"):
        self.name, self.corpus, self.qrels, self.encoder, self.tokenizer, self.split = name, corpus, qrels, encoder, tokenizer, split

    @cached_property
    def bm25(self) -> BM25Retriever:
        return MultiFieldBM25Retriever(tokenizer=self.tokenizer).index(self.corpus)

    @cached_property
    def concatenated(self) -> BM25Retriever:
        return BM25Retriever(tokenizer=self.tokenizer).index(self.corpus)

    @cached_property
    def dense(self) -> DenseRetriever | None:
        return None if self.encoder is None else DenseRetriever(self.encoder).index(self.corpus)

    def _queries(self, query: str) -> DataFrame:
        return self.corpus.sparkSession.createDataFrame([("q", query)], "query_id string, text string")

    def runs(self, queries: DataFrame, method: str = "hybrid", k: int = DEPTH) -> tuple[DataFrame, list[str]]:
        """The run of ``method`` (bm25, dense or hybrid) and the methods that it really used."""
        if method not in ("bm25", "dense", "hybrid"):
            raise ValueError("method must be bm25, dense or hybrid")
        if method == "dense" and self.dense is None:
            raise RuntimeError("there is no encoder")
        found = {}
        if method != "dense":
            found["bm25"] = self.bm25.retrieve(queries, max(k, DEPTH))
        if method != "bm25" and self.dense is not None:
            found["dense"] = self.dense.retrieve(queries, max(k, DEPTH))
        run = next(iter(found.values())).where(F.col("rank") <= k) if len(found) == 1 else reciprocal_rank_fusion(list(found.values()), FUSION_K, k)
        return run, list(found)

    def search(self, query: str, top_k: int = 10, method: str = "hybrid") -> dict:
        run, used = self.runs(self._queries(query), method, top_k)
        rows = result_rows(run, self.corpus).orderBy("rank").collect()
        notes = [] if self.encoder is not None or method == "bm25" else ["there is no encoder: lexical search only"]
        return {"query": query, "dataset": self.name, "methods": used, "rrf_k": FUSION_K if len(used) > 1 else None, "depth": max(top_k, DEPTH), "notes": notes, "results": [{"doc_id": r.doc_id, "score": r.score, "title": r.title, "snippet": r.snippet} for r in rows]}

    def compare_methods(self, query: str, top_k: int = 5) -> dict:
        q = self._queries(query)
        lexical, _ = self.runs(q, "bm25", top_k)
        other, used = self.runs(q, "dense" if self.dense is not None else "bm25", top_k)
        shared = overlap(lexical, other, top_k).collect()
        stats = self.concatenated.query_statistics(q).drop("query_id").first().asDict()
        return {"query": query, "bm25": self.search(query, top_k, "bm25")["results"], used[0]: self.search(query, top_k, used[0])["results"], "shared": shared[0].shared if shared else 0, "query_statistics": stats}

    def answer(self, query: str, model: generation.Model, top_k: int = 5, settings: generation.Settings = generation.Settings(max_new_tokens=160)) -> dict:
        """An answer of ``model`` from the first ``top_k`` documents, with its citations checked; no documents
        is an error."""
        q = self._queries(query)
        run, used = self.runs(q, "hybrid", top_k)
        rows = generation.answer(format_sources(run, self.corpus), q, run, model, settings).drop("query_id").collect()
        if not rows:
            raise ValueError("there are no documents to answer from")
        return {**rows[0].asDict(), "methods": used, "settings": settings.describe("answer")}

    def describe_benchmark(self) -> dict:
        if self.qrels is None:
            raise ValueError("there are no judgements")
        levels = sorted(r[0] for r in self.qrels.select("grade").distinct().collect())  # grades are few
        return {"dataset": self.name, "split": self.split, "published_ndcg_10": PUBLISHED_NDCG_10.get(self.name), **describe_benchmark(self.corpus, self.qrels).first().asDict(), "levels": levels, "retriever": self.bm25.describe(), "caveat": CAVEAT}
