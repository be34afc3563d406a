"""A lexical index that changes: documents are added, replaced and deleted without reading the others again.

An index is a list of segments, each a written :class:`~irspan.operators.bm25.LexicalIndex` of the documents
that came together, and never altered.  A document that is deleted, or comes again, is struck from the
segments before; the statistics that scores depend on (documents and average length of each field, document
frequency of each term) are those of all documents that are left, put together from the segments' tables: sums
of what they have, less what the struck documents had there.  So scores equal those of an index of what is
left.  A segment with more than :data:`MOST_STRUCK` struck documents, which searches have to know by name, is
written anew from its own counted terms; ``compact`` does so with all segments as one.

Defined cases: deleting what is not there changes nothing; a document that comes twice in one lot is an error, and so
is an index of which nothing is left; a field that is empty in all documents scores nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irspan.functions.text import Tokenizer
from irspan.operators.bm25 import BM25Retriever, LexicalIndex, query_terms
from irspan.operators.physical import BROADCAST_ROWS, scratch, shared_folder, temporary, written
from irspan.operators.ranking import top_k

#: Struck documents of a segment that searches leave out by name.
MOST_STRUCK = BROADCAST_ROWS


@dataclass(frozen=True)
class Segment:
    """A written index and the ids (doc_id) struck from it."""

    index: LexicalIndex
    struck: DataFrame | None = None
    n_struck: int = 0

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with doc_id) of documents that are not struck."""
        return rows if self.struck is None else rows.join(self.struck, "doc_id", "left_anti")

    def lost(self, rows: DataFrame) -> DataFrame:
        """``rows`` of struck documents."""
        return rows.join(self.struck, "doc_id", "left_semi") if self.struck is not None else rows.where("false")

    def without(self, ids: DataFrame) -> Segment:
        """The segment less the documents ``ids`` (doc_id)."""
        held = self.index.lengths.select("doc_id").distinct()
        now = held.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        if self.struck is not None:
            now = now.unionByName(self.struck).distinct()
        struck = written(now, "struck")
        n = struck.count()
        if not n:
            return self
        after = Segment(self.index, struck, n)
        return after if n <= MOST_STRUCK else after.rewritten()

    def rewritten(self) -> Segment:
        return Segment(LexicalIndex.write(self.live(self.index.documents), shared_folder(self.index.documents.sparkSession, "index")))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class SegmentedBM25:
    """BM25 over documents that change; every change gives a new retriever over the same files."""

    k1: float = 0.9
    b: float = 0.4
    tokenizer: Tokenizer = field(default_factory=Tokenizer)
    fields: tuple[str, ...] | None = None
    segments: tuple[Segment, ...] = ()
    statistics: tuple[DataFrame, DataFrame] | None = None

    def index(self, corpus: DataFrame) -> SegmentedBM25:
        """A first segment of ``corpus`` (doc_id, title, text)."""
        return replace(self, segments=()).add(corpus)

    def add(self, corpus: DataFrame) -> SegmentedBM25:
        """With the documents of ``corpus``: those that are there already are replaced."""
        one = LexicalIndex.build(corpus, self.tokenizer, self.fields)
        ids = one.lengths.select("doc_id").distinct()
        if corpus.count() != ids.count():
            raise ValueError("a document came twice, or without an id")
        before = tuple(s.without(ids) for s in self.segments)
        return replace(self, segments=(*before, Segment(one)))._counted()

    def delete(self, ids: DataFrame) -> SegmentedBM25:
        """Without the documents ``ids`` (doc_id)."""
        return replace(self, segments=tuple(s.without(ids) for s in self.segments))._counted()

    def compact(self) -> SegmentedBM25:
        """One segment of what is left, from the counted terms: no text is read."""
        spark = self.segments[0].index.documents.sparkSession
        live = _union([s.live(s.index.documents) for s in self.segments])
        return replace(self, segments=(Segment(LexicalIndex.write(live, shared_folder(spark, "index"))),))._counted()

    def _counted(self) -> SegmentedBM25:
        """The statistics of what is left: fields (field, n, avgdl) and terms (field, term, df, idf), written."""
        lengths = _union([s.live(s.index.lengths) for s in self.segments])
        fields = written(lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "fields")
        if not fields.count():  # a row a field
            raise ValueError("nothing is left in the index")
        had = [s.index.terms.select("field", "term", "df") for s in self.segments]
        less = [s.index.postings(s.lost(s.index.documents)).groupBy("field", "term").agg((-F.count("*")).alias("df")) for s in self.segments if s.struck is not None]
        df = _union(had + less).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        return replace(self, statistics=(fields, written(df.join(F.broadcast(fields), "field").select("field", "term", "df", idf), "terms")))

    def retrieve(self, queries: DataFrame, top_k_: int = 100) -> DataFrame:
        """The run of the best documents of each of ``queries`` (query_id, text): the best of each segment, ranked."""
        if self.statistics is None:
            raise RuntimeError("index() comes first")
        fields, terms = self.statistics
        averages = tuple((r.field, r.avgdl) for r in fields.collect())  # a row a field
        with scratch():
            asked = query_terms(queries, self.tokenizer)
            known = temporary(terms.join(asked, "term").select("query_id", "field", "term", (F.col("weight") * F.col("idf")).alias("weight")), "terms")
            best = []
            for s in self.segments:
                scorer = BM25Retriever(self.k1, self.b, self.tokenizer, self.fields, indexed=replace(s.index, averages=averages))
                gone = frozenset(r.doc_id for r in s.struck.collect()) if s.struck is not None else frozenset()  # MOST_STRUCK at most
                best.append(s.index.impacts.best(known, scorer.impact(), top_k_, gone))
            return top_k(_union(best), top_k_)

    def describe(self) -> dict:
        return {"model": "bm25", "k1": self.k1, "b": self.b, "fields": self.fields, "tokenizer": self.tokenizer.describe(), "segments": len(self.segments), "struck": sum(s.n_struck for s in self.segments)}
