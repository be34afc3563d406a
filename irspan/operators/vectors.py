"""Retrieval with vectors: dense, learned sparse and late interaction.

Models are plug-ins that give vectors (see :class:`Encoder`); the operators work on frames of vectors.
Queries are a stated set: their vectors are broadcast, and each task compares its rows of the corpus with
them in blocks of matrix products and sends on the best documents of each query only, so neither pairs nor
scores are moved.  One scan of the corpus serves up to :data:`PASS_BYTES` of query vectors; of more, a part is
compared and its best written before the next one comes to the driver, which so never holds two.
Term weights are searched by document shards with bounds (see :mod:`impacts`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from irspan.operators.impacts import ImpactFrame, ImpactIndex
from irspan.operators.physical import scratch, shared_folder, temporary, written
from irspan.operators.ranking import DECIMALS, top_k

#: Bytes of query vectors that one scan of the corpus is compared with, and that one product takes of them.
PASS_BYTES, BLOCK_BYTES = 128 << 20, 4 << 20
#: Scores (numbers of a product) that a task holds at a time.
BLOCK_SCORES = 1 << 21
#: Best documents (of all queries) that a task may keep until its end, and those that wait to be compared with them.
KEPT_ROWS, WAITING_ROWS = 1 << 20, 1 << 16


class Encoder(Protocol):
    """A model: texts to vectors."""

    def encode(self, texts: DataFrame, text_column: str = "text") -> DataFrame:
        """``texts`` with a column ``embedding`` (array of float)."""


class TokenEncoder(Protocol):
    """A model that gives a vector for each position of a text."""

    def encode_tokens(self, texts: DataFrame, text_column: str = "text", is_query: bool = False) -> DataFrame:
        """A row for each kept position: the other columns of ``texts``, ``pos`` and ``embedding``."""


def _words(text_column: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_column), F.lit(""))), r"\s+"), lambda w: w != "")


class VocabularyEncoder:
    """Counts of the words of a fixed vocabulary, as unit vectors: a deterministic stand-in for a model.

    As a token encoder, a word of the vocabulary is a unit vector along its own axis.
    """

    def __init__(self, vocabulary: tuple[str, ...]):
        self.vocabulary = vocabulary

    def encode(self, texts: DataFrame, text_column: str = "text") -> DataFrame:
        known, size = pa.array(self.vocabulary, pa.string()), len(self.vocabulary)
        lowered, names = F.lower(F.coalesce(F.col(text_column), F.lit(""))), [*texts.columns, "embedding"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = pc.split_pattern_regex(batch.column(batch.num_columns - 1), "[ \\t\\n\\x0b\\f\\r]+")
                at = pc.index_in(words.flatten(), known)
                row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
                there = np.asarray(at.is_valid())
                cells = row[there] * size + at.drop_null().to_numpy().astype(np.int64)
                counts = np.bincount(cells, minlength=len(words) * size).reshape(len(words), size)
                unit = _unit(counts)
                vectors = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * size, unit.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=names)

        return texts.select("*", lowered.alias("lowered")).mapInArrow(run, StructType([*texts.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))

    def encode_tokens(self, texts: DataFrame, text_column: str = "text", is_query: bool = False) -> DataFrame:
        known = F.filter(_words(text_column), lambda w: w.isin(*self.vocabulary))
        rows = texts.select(*(c for c in texts.columns if c != text_column), F.posexplode(known).alias("pos", "word"))
        axis = F.transform(F.array(*(F.lit(v) for v in self.vocabulary)), lambda v: (v == F.col("word")).cast("double"))
        return rows.withColumn("embedding", axis).drop("word")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _passes(vectors: DataFrame) -> Iterator[tuple[pa.Table, bool]]:
    """Query vectors (query_id, embedding and others), those of a query together, in tables of about PASS_BYTES;
    and whether there are more than one."""
    with scratch():
        kept = temporary(vectors, "query_vectors")
        size = kept.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
        n = max(1, -(-int(size) // PASS_BYTES))
        for i in range(n):
            yield (kept.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else kept).toArrow(), n > 1


def _best(scores: np.ndarray, docs: list, queries: list | np.ndarray, k: int, floor: np.ndarray | None = None) -> pa.RecordBatch:
    """The ``k`` best documents (columns, by rising id) of each query (rows) that reach its ``floor``; of ties at the
    cut-off the least ids, as ranks have it: scores are rounded already, so no other one of these can be among a query's best."""
    n = min(k, len(docs))
    cut = np.partition(scores, len(docs) - n, axis=1)[:, len(docs) - n, None]
    over, tie = scores > cut, scores == cut
    wanted = over | (tie & (np.cumsum(tie, axis=1) <= n - over.sum(axis=1, keepdims=True)))
    r, c = np.nonzero(wanted if floor is None else wanted & (scores >= floor[:, None]))
    return pa.RecordBatch.from_arrays([pa.array(queries).take(pa.array(r)), pa.array(docs, pa.string()).take(pa.array(c)), pa.array(scores[r, c])], ["query_id", "doc_id", "score"])


class _Best:
    """The ``k`` best documents of each of a task's queries.

    They are kept until the task's end, so that it sends on ``k`` rows a query however many blocks it compares; of more
    than :data:`KEPT_ROWS`, those of each block are sent on.  A document's chunks may come in several blocks.
    """

    def __init__(self, ids: list, k: int):
        self.ids, self.k, self.most = pa.array(ids, pa.string()), k, len(ids) * k
        self.floor = np.full(len(ids), -np.inf)  # what a score must reach
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, scores: np.ndarray, docs: list, first: int) -> Iterator[pa.RecordBatch]:
        """Rounded scores of documents (columns, by rising id) for queries (rows, from number ``first``)."""
        numbers = np.arange(first, first + len(scores))
        found = pa.Table.from_batches([_best(scores, docs, numbers, self.k, self.floor[numbers])])
        if self.most > KEPT_ROWS:
            yield from self._rows(found)
            return
        self.held.append(found)
        self.rows += found.num_rows
        if self.rows > 2 * self.most + WAITING_ROWS:
            self._cut()

    def _cut(self) -> None:
        best = pa.concat_tables(self.held).group_by(["query_id", "doc_id"]).aggregate([("score", "max")]).rename_columns({"score_max": "score"}).select(["query_id", "doc_id", "score"])
        best = best.sort_by([("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
        query = best.column("query_id").to_numpy()
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(nth == self.k - 1)
        self.floor[query[last]] = best.column("score").to_numpy()[last]
        self.held = [best.filter(pa.array(nth < self.k))]
        self.rows = self.held[0].num_rows

    def _rows(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        names = self.ids.take(found.column("query_id").combine_chunks())
        yield from pa.table([names, found.column("doc_id"), found.column("score")], ["query_id", "doc_id", "score"]).combine_chunks().to_batches()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            yield from self._rows(self.held[0])


def _spans(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring items whose lengths add up to ``most``; a longer item is a run of its own."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _most(q: np.ndarray, d: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each row of ``q`` the largest dot product with each document's rows of ``d``.  A document that is too
    long for one product is taken in pieces."""
    size = max(1, BLOCK_SCORES // len(q))
    if len(d) <= size:
        return np.maximum.reduceat(q @ d.T, np.cumsum(lengths) - lengths, axis=1)
    if len(lengths) > 1:
        ends = np.cumsum(lengths)
        return np.concatenate([_most(q, d[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b]) for a, b in _spans(lengths, size)], axis=1)
    best = np.full((len(q), 1), -np.inf)
    for i in range(0, len(d), size):
        np.maximum(best, (q @ d[i : i + size].T).max(axis=1, keepdims=True), out=best)
    return best


_SCORES = "query_id string, doc_id string, score double"


def _scanned(rows: DataFrame, queries: DataFrame, prepare: Callable[[pa.Table], tuple], run: Callable) -> DataFrame:
    """The union of ``run`` over ``rows`` for each part of the query vectors, as ``prepare`` makes it: one scan a part."""
    spark = rows.sparkSession
    parts = []
    for table, more in _passes(queries):
        if not table.num_rows:
            continue
        held = spark.sparkContext.broadcast(prepare(table))
        found = rows.mapInArrow(run(held), _SCORES)
        parts.append(written(found, "best") if more else found)
        if more:
            held.unpersist()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _SCORES)


def dense_retrieve(queries: DataFrame, documents: DataFrame, k: int = 100) -> DataFrame:
    """Exact nearest documents by cosine: a document's score is that of its best chunk.

    ``queries``: query_id and embedding; ``documents``: doc_id and embedding, one row for each chunk,
    the chunks of a document in one row group or spread.  No score is dropped.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def prepare(table: pa.Table) -> tuple:
        return table.column(0).to_pylist(), _unit(_matrix(table.column(1).combine_chunks()))

    def run(held) -> Callable:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            step = max(1, min(BLOCK_BYTES // (8 * q.shape[1]), BLOCK_SCORES >> 8))
            best = _Best(ids, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = batch.column(0).dictionary_encode()
                docs = sorted(codes.dictionary.to_pylist())
                place = np.empty(len(docs), np.int64)
                place[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(docs))
                at = place[codes.indices.to_numpy()]
                order = np.argsort(at, kind="stable")  # a document's chunks side by side
                d, lengths = _unit(_matrix(batch.column(1)))[order], np.bincount(at)
                ends = np.cumsum(lengths)
                for i in range(0, len(ids), step):
                    some = q[i : i + step]
                    for a, b in _spans(lengths, max(1, BLOCK_SCORES // len(some))):
                        most = np.round(_most(some, d[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b]), DECIMALS)
                        yield from best.add(most, docs[a:b], i)
            yield from best.rest()

        return compare

    best = _scanned(documents.select(F.col("doc_id").cast("string"), "embedding"), queries.select("query_id", "embedding"), prepare, run)
    return top_k(best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, drop_zero=False)


def sparse_encode(logits: DataFrame, top_terms: int | None = None, key: str = "doc_id") -> DataFrame:
    """Term weights from logits by position (key, pos, embedding): the largest ``log(1 + relu)`` of each term."""
    terms = logits.select(key, F.posexplode("embedding").alias("term_id", "x")).select(key, "term_id", F.log1p(F.greatest(F.col("x").cast("double"), F.lit(0.0))).alias("w"))
    out = terms.groupBy(key, "term_id").agg(F.round(F.max("w"), DECIMALS).alias("weight")).where("weight > 0")
    if top_terms is not None:
        order = Window.partitionBy(key).orderBy(F.desc("weight"), "term_id")
        out = out.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top_terms).drop("nth")
    return out


def mean_terms(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean number of terms of a document."""
    return postings.groupBy(key).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_terms"))


def _as_postings(postings: DataFrame) -> DataFrame:
    return postings.select(F.lit("").alias("field"), F.col("term_id").cast("string").alias("term"), F.col("doc_id").cast("string").alias("doc_id"), F.col("weight").cast("double").alias("x"), F.lit(0.0).alias("y"))


def sparse_index(postings: DataFrame) -> ImpactIndex:
    """``postings`` (doc_id, term_id, weight, not negative) written by document shards, for many searches."""
    return ImpactIndex.build(_as_postings(postings), shared_folder(postings.sparkSession, "sparse"))


def sparse_retrieve(queries: DataFrame, postings: DataFrame | ImpactIndex, k: int = 100) -> DataFrame:
    """Dot products of term weights: ``queries`` query_id, term_id, weight; ``postings`` doc_id, term_id, weight, or
    an index of them.  A term of every document is a block in each shard, never one task."""
    if k <= 0:
        raise ValueError("k must be positive")
    with scratch():
        terms = temporary(queries.select("query_id", F.lit("").alias("field"), F.col("term_id").cast("string").alias("term"), F.col("weight").cast("double").alias("weight")).where("weight <> 0"), "terms")
        found = postings if isinstance(postings, ImpactIndex) else ImpactFrame(_as_postings(postings))
        return top_k(found.best(terms, _own_weight, k), k)


def _own_weight(field: str, weight: np.ndarray, _: np.ndarray) -> np.ndarray:
    return weight


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows (doc_id, flat, n) of one document as one row; it may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def rows(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        cuts = (offsets - offsets[0])[np.append(starts, len(lists))].astype(np.int32)
        n = np.add.reduceat(batch.column(2).to_numpy(zero_copy_only=False), starts).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.ListArray.from_arrays(cuts, lists.flatten()), pa.array(n)], ["doc_id", "flat", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[0].column(0)[0] == batch.column(0)[0] == batch.column(0)[batch.num_rows - 1]:
            held.append(batch)
            continue
        batch = pa.concat_batches([*held, batch])
        ids = batch.column(0)
        starts = np.flatnonzero(np.append(True, np.asarray(pc.not_equal(ids[1:], ids[:-1]))))
        if len(starts) > 1:
            yield rows(batch.slice(0, starts[-1]), starts[:-1])
        held = [batch.slice(starts[-1])]
    if held:
        yield rows(pa.concat_batches(held), np.zeros(1, np.int64))


_DOCUMENTS = "doc_id string, flat array<double>, n int"


def by_document(tokens: DataFrame) -> DataFrame:
    """doc_id, its vectors end to end (flat) and their number n, from ``tokens`` (doc_id, pos, embedding), written.

    Encoders give a document's tokens one after the other, so they are put together where they are; documents
    are moved only if one came in several parts.
    """
    empty = F.raise_error(F.concat(F.lit("no token is left of document "), F.col("doc_id").cast("string"))).cast("array<double>")
    vector = F.when(F.col("embedding").isNull(), empty).otherwise(F.col("embedding").cast("array<double>"))
    parts = temporary(tokens.select(F.col("doc_id").cast("string").alias("doc_id"), vector.alias("flat"), F.lit(1).alias("n")).mapInArrow(_joined, _DOCUMENTS), "documents")
    if parts.count() == parts.select("doc_id").distinct().count():
        return parts
    return temporary(parts.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_joined, _DOCUMENTS), "documents")


def maxsim_retrieve(queries: DataFrame, tokens: DataFrame, k: int = 100) -> DataFrame:
    """Late interaction: over a query's tokens, the sum of the best dot product in a document.

    ``queries``: query_id, pos, embedding; ``tokens``: doc_id, pos, embedding, or what :func:`by_document` made
    of them.  Documents are compared in blocks; a task sends on the best documents of each query.  No score is dropped.  A document without a token (a row whose embedding is null) is an error: it
    would have no score.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def prepare(table: pa.Table) -> tuple:
        table = table.sort_by([("query_id", "ascending"), ("pos", "ascending")])
        names = np.array(table.column(0).to_pylist(), object)
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        return names[starts].tolist(), starts, _matrix(table.column(1).combine_chunks())

    gathered = tokens if "flat" in tokens.columns else by_document(tokens)

    def run(held) -> Callable:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, starts, q = held.value
            sizes = np.diff(np.append(starts, len(q)))
            most = max(1, min(BLOCK_BYTES // (8 * q.shape[1]), BLOCK_SCORES >> 8))
            found = _Best(ids, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = pc.sort_indices(batch.column(0))
                batch = batch.take(order)
                docs = batch.column(0).to_pylist()
                lengths = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                d = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                ends = np.cumsum(lengths)
                for i, j in _spans(sizes, most):  # whole queries
                    some = q[starts[i] : starts[j - 1] + sizes[j - 1]]
                    for a, b in _spans(lengths, max(1, BLOCK_SCORES // len(some))):
                        best = _most(some, d[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b])
                        yield from found.add(np.round(np.add.reduceat(best, starts[i:j] - starts[i], axis=0), DECIMALS), docs[a:b], i)
            yield from found.rest()

        return compare

    return top_k(_scanned(gathered, queries.select("query_id", "embedding", "pos"), prepare, run), k, drop_zero=False)
