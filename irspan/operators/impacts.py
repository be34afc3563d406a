"""Postings by document shards with bounds for each block, and exact top-k over them.

Documents are dealt into shards by a hash, and a shard holds all terms of its documents: a row (block) for each
field and term, with its postings and the bounds of their numbers (largest ``x``, smallest ``y``).  The number
of shards comes from the counted postings, so tasks grow with the corpus and a term of every document is as
many blocks as there are shards.  The table is bucketed by shard: grouping by shard reads each bucket where
it lies, and only documents that may be among a shard's best are moved.

A query's blocks are taken by falling bound.  Once what the rest can add is below the k-th best score so
far, no other document can come in; the rest is then only looked at for those that still can, and ever
fewer can.  Nothing is approximate: a document at the cut-off, ties by rounding included, is always kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.operators.physical import BROADCAST_ROWS, drop, written
from irspan.operators.ranking import DECIMALS

#: Postings of a shard, about: what a search's task may have to hold (of the terms that are asked for).
SHARD_POSTINGS = 2_000_000
#: Postings that are made blocks of at a time.
WRITTEN = 1 << 18
#: Weights (query terms by cells) that are broadcast at a time, and products that a task makes at a time.
CELL_WEIGHTS, PRODUCTS = 2_000_000, 1 << 21
#: What rounding may hide of a score.
SLACK = 2 * 10.0**-DECIMALS

_BLOCKS = "shard int, field string, term string, entries array<struct<doc:string,x:double,y:double>>, n int, most double, least double"
_SCORES = "query_id string, doc_id string, score double"
_COUNTS = "shard int, queries long, postings long, scored long"

#: What a posting adds to a unit of a term's weight, by field, from arrays ``x`` and ``y``: it must not fall with x nor rise with y.
Impact = Callable[[str, np.ndarray, np.ndarray], np.ndarray]


def _even_numbers(spark: SparkSession, n: int) -> DataFrame:
    """For each of ``n`` buckets the least number that Spark's hash puts there: nth and shard."""
    numbers = spark.range(40 * n + 64).select(F.col("id").cast("int").alias("i"))
    return numbers.groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("nth")).agg(F.min("i").alias("shard"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings as blocks.  A block of a batch's end may go on in the next one; it is at most a shard's."""
    held: list[pa.RecordBatch] = []

    def blocks(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        x, y = rows.column(4).to_numpy(), rows.column(5).to_numpy()
        offsets = np.append(starts, len(x)).astype(np.int32)
        entries = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(rows.columns[3:], ["doc", "x", "y"]))
        keys = [rows.column(i).take(pa.array(starts)) for i in range(3)]
        return pa.RecordBatch.from_arrays([*keys, entries, pa.array(np.diff(offsets)), pa.array(np.maximum.reduceat(x, starts)), pa.array(np.minimum.reduceat(y, starts))], ["shard", "field", "term", "entries", "n", "most", "least"])

    def starts_of(rows: pa.RecordBatch) -> np.ndarray:
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.any([np.asarray(pc.not_equal(c[1:], c[:-1])) for c in rows.columns[:3]], axis=0)
        return np.flatnonzero(new)

    def key(rows: pa.RecordBatch, i: int) -> tuple:
        return tuple(rows.column(c)[i].as_py() for c in range(3))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[0], 0) == key(batch, 0) == key(batch, batch.num_rows - 1):
            held.append(batch)
            continue
        rows = pa.concat_batches([*held, batch])
        starts = starts_of(rows)
        if len(starts) > 1:
            yield blocks(rows.slice(0, starts[-1]), starts[:-1])
        held = [rows.slice(starts[-1])]
    if held:
        yield blocks(pa.concat_batches(held), np.zeros(1, np.int64))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task's shards (shard, field, doc_id, dl, terms, tfs) as blocks.  A posting is held as three numbers."""
    places: dict[tuple[int, str], int] = {}
    known: dict[str, int] = {}
    ids, parts, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.array([places.setdefault(key, len(places)) for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int32)
        codes = batch.column(4).flatten().dictionary_encode()
        number = np.array([known.setdefault(t, len(known)) for t in codes.dictionary.to_pylist()], np.int32)
        sizes = np.diff(batch.column(4).offsets.to_numpy())
        at = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)
        parts.append((place[at], number[codes.indices.to_numpy()], at + np.int32(n), batch.column(5).flatten().to_numpy().astype(np.int32)))
        ids.append((batch.column(2), batch.column(3).to_numpy()))
        n += batch.num_rows
    if not parts or not known:
        return
    doc, dl = pa.chunked_array([x for x, _ in ids]).combine_chunks(), np.concatenate([y for _, y in ids]).astype(np.float64)
    names = pa.array(list(known), pa.string())
    rank = np.empty(len(known), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(known))
    place, term, row, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    nth = np.array(sorted(range(len(places)), key=list(places).__getitem__), np.int64)
    turn = np.empty(len(places), np.int64)
    turn[nth] = np.arange(len(nth))
    key = turn[place] * len(known) + rank[term]
    order = np.argsort(key, kind="stable")
    key, term, place, row, tf = key[order], term[order], place[order], row[order], tf[order].astype(np.float64)
    starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    shards, fields = [p[0] for p in places], [p[1] for p in places]
    a = 0
    while a < len(starts) - 1:  # blocks of about WRITTEN postings at a time
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + WRITTEN, side="right")) - 1)
        lo, hi, first = starts[a], starts[b], starts[a:b]
        x, y = tf[lo:hi], dl[row[lo:hi]]
        entries = pa.ListArray.from_arrays((starts[a : b + 1] - lo).astype(np.int32), pa.StructArray.from_arrays([doc.take(pa.array(row[lo:hi])), pa.array(x), pa.array(y)], ["doc", "x", "y"]))
        head = [pa.array([shards[i] for i in place[first]], pa.int32()), pa.array([fields[i] for i in place[first]], pa.string()), names.take(pa.array(term[first]))]
        yield pa.RecordBatch.from_arrays([*head, entries, pa.array(np.diff(starts[a : b + 1]).astype(np.int32)), pa.array(np.maximum.reduceat(x, first - lo)), pa.array(np.minimum.reduceat(y, first - lo))], ["shard", "field", "term", "entries", "n", "most", "least"])
        a = b


@dataclass(frozen=True)
class ImpactIndex:
    """A written index: ``blocks`` (shard, field, term, entries, n, most, least), bucketed by shard."""

    folder: str
    table: str
    shards: int
    blocks: DataFrame

    @classmethod
    def build(cls, postings: DataFrame, folder: str, n_postings: int | None = None) -> ImpactIndex:
        """Write ``postings`` (field, term, doc_id and numbers x and y) under ``folder``; one shuffle."""
        n, rows = cls._dealt(postings, postings.count() if n_postings is None else n_postings)
        rows = rows.select("shard", "field", "term", F.col("doc_id").alias("doc"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        return cls._written(rows.repartition(n, "shard").sortWithinPartitions("shard", "field", "term").mapInArrow(_gathered, _BLOCKS), folder, n)

    @classmethod
    def of_documents(cls, documents: DataFrame, folder: str, n_postings: int) -> ImpactIndex:
        """Write documents (field, doc_id, dl, terms, tfs), x their tfs and y their dl.  A document is moved as one
        row, and a shard's postings are sorted as numbers where they arrive, so nothing is spilled."""
        n, rows = cls._dealt(documents, n_postings)
        return cls._written(rows.select("shard", "field", "doc_id", "dl", "terms", "tfs").repartition(n, "shard").mapInArrow(_inverted, _BLOCKS), folder, n)

    @staticmethod
    def _dealt(rows: DataFrame, n_postings: int) -> tuple[int, DataFrame]:
        """The number of shards, and ``rows`` with their document's."""
        n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_postings // SHARD_POSTINGS))
        places = F.broadcast(_even_numbers(rows.sparkSession, n))  # a row a shard
        return n, rows.withColumn("nth", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).join(places, "nth")

    @classmethod
    def _written(cls, blocks: DataFrame, folder: str, n: int) -> ImpactIndex:
        spark = blocks.sparkSession
        name = f"impacts_{uuid.uuid4().hex}"
        blocks.write.format("parquet").bucketBy(n, "shard").option("path", f"{folder}/blocks").saveAsTable(name)
        spark.createDataFrame([(n,)], "shards int").coalesce(1).write.parquet(f"{folder}/layout")
        return cls(folder, name, n, spark.table(name))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> ImpactIndex:
        """The index that was written under ``folder``."""
        n = spark.read.parquet(f"{folder}/layout").first().shards
        name = f"impacts_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({_BLOCKS}) USING parquet CLUSTERED BY (shard) INTO {n} BUCKETS LOCATION '{folder}/blocks'")
        return cls(folder, name, n, spark.table(name))

    def drop(self) -> None:
        """The index's files, and its name in the catalog."""
        spark = self.blocks.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        for part in ("blocks", "layout"):
            drop(spark, f"{self.folder}/{part}")

    def postings(self) -> DataFrame:
        """field, term, doc_id, x and y, a row a posting."""
        return self.blocks.select("field", "term", F.inline("entries")).withColumnRenamed("doc", "doc_id")

    def document_frequencies(self) -> DataFrame:
        """field, term and df."""
        return self.blocks.groupBy("field", "term").agg(F.sum("n").alias("df"))

    def _met(self, wanted: DataFrame) -> DataFrame:
        """The blocks of terms (field, term), a row a block, those of a shard to be grouped by it."""
        return self.blocks.join(wanted, ["field", "term"], "left_semi")

    def _parts(self, terms: DataFrame, rows: int) -> list[DataFrame]:
        """Query terms in parts of about ``rows``, those of a query together."""
        n = max(1, -(-terms.count() // rows))
        return [terms.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [terms]

    def _shards(self, terms: DataFrame, run: Callable, schema: str, prepare: Callable[[pa.Table], object] | None = None, rows: int | None = None, weight: str = "weight") -> DataFrame:
        """``run`` on the blocks of the terms, shard by shard.  A part of the queries is done and written before
        the next one comes to the driver, so what it holds does not grow with them."""
        spark = terms.sparkSession
        parts = self._parts(terms, rows or BROADCAST_ROWS)
        done = []
        for part in parts:
            asked = part.select("query_id", "field", "term", weight).toArrow()  # so many rows, about
            shared = spark.sparkContext.broadcast((prepare or _by_query)(asked))
            wanted = F.broadcast(spark.createDataFrame(asked.select(["field", "term"]).group_by(["field", "term"]).aggregate([])))
            found = self._met(wanted).groupBy("shard").applyInArrow(run(shared), schema)
            done.append(found if len(parts) == 1 else written(found, "best"))
            if len(parts) > 1:
                shared.unpersist()
        return reduce(DataFrame.unionByName, done)

    def best(self, terms: DataFrame, impact: Impact, k: int, gone: frozenset[str] = frozenset()) -> DataFrame:
        """Scores (query_id, doc_id, score) of all documents that may be among a query's ``k`` best: each
        shard's own best, without those in ``gone``.  ``terms``: query_id, field, term, weight; they are read at once."""
        left_out = self.blocks.sparkSession.sparkContext.broadcast(gone) if gone else None

        def run(shared) -> Callable:
            def score(table: pa.Table) -> pa.Table:
                shard = _Shard(table, impact)
                if left_out is not None:
                    shard.leave_out(left_out.value)
                out = []
                for query, wanted in shared.value:
                    docs, scores = shard.top(wanted, k)
                    if len(docs):
                        kept = shard.first(docs, scores, k)
                        docs, scores = docs[kept], scores[kept]
                        out.append(pa.table([pa.array([query] * len(docs), pa.string()), shard.names.take(pa.array(docs)), pa.array(scores)], ["query_id", "doc_id", "score"]))
                return pa.concat_tables(out) if out else pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())]).empty_table()

            return score

        return self._shards(terms, run, _SCORES)

    def best_of_cells(self, terms: DataFrame, impacts: Callable[[str, np.ndarray, np.ndarray], np.ndarray], cells: int, k: int) -> DataFrame:
        """cell, query_id, doc_id and score of the ``k`` best documents of every query in each of ``cells`` cells,
        and of all that tie with them: what parameters change is a column of a matrix, what they don't is read
        once for all.  ``terms``: query_id, field, term and weights, an array of (cell, weight), or of one weight
        of cell -1 that counts in all; ``impacts``: postings by cells, or by one column that holds for all."""

        def run(shared) -> Callable:
            def score(table: pa.Table) -> pa.Table:
                shard = _Shard(table, None)
                out = []
                for query, wanted in shared.value[0]:
                    cell, docs, scores = shard.top_of_cells(wanted, shared.value[1], impacts, cells, k)
                    if len(docs):
                        kept = shard.first(docs, scores, k, cell)
                        cell, docs, scores = cell[kept], docs[kept], scores[kept]
                        out.append(pa.table([pa.array(cell, pa.int32()), pa.array([query] * len(docs), pa.string()), shard.names.take(pa.array(docs)), pa.array(scores)], ["cell", "query_id", "doc_id", "score"]))
                return pa.concat_tables(out) if out else _CELL_SCORES.empty_table()

            return score

        return self._shards(terms, run, "cell int, query_id string, doc_id string, score double", lambda t: _weights_by_query(t, cells), max(1, CELL_WEIGHTS // cells), "weights")

    def effort(self, terms: DataFrame, impact: Impact, k: int) -> DataFrame:
        """For each shard: queries with a posting there, postings of their terms, and how many were scored."""

        def run(shared) -> Callable:
            def count(table: pa.Table) -> pa.Table:
                shard = _Shard(table, impact)
                met = sum(len(shard.top(wanted, k)[0]) > 0 for _, wanted in shared.value)
                return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([met]), pa.array([shard.met]), pa.array([shard.scored])], ["shard", "queries", "postings", "scored"])

            return count

        return self._shards(terms, run, _COUNTS)


class ImpactFrame(ImpactIndex):
    """Postings (field, term, doc_id, x, y) that are not indexed, searched once: those of the terms are moved to
    their document's shard, and put together as blocks there."""

    def __init__(self, postings: DataFrame):
        spark = postings.sparkSession
        n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        super().__init__("", "", n, postings)

    def _met(self, wanted: DataFrame) -> DataFrame:
        rows = self.blocks.join(wanted, ["field", "term"], "left_semi")
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(self.shards)).cast("int")
        return rows.select(shard.alias("shard"), "field", "term", F.col("doc_id").alias("doc"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _as_blocks(table: pa.Table) -> pa.Table:
    """A shard's blocks; of an :class:`ImpactFrame`, they are made of its postings."""
    if "entries" in table.column_names:
        return table
    rows = table.sort_by([("field", "ascending"), ("term", "ascending")]).combine_chunks()
    return pa.Table.from_batches(_gathered(iter(rows.to_batches())))


def _by_query(asked: pa.Table) -> list[tuple[str, list[tuple[tuple[str, str], float]]]]:
    """Query terms by query: ((field, term), weight)."""
    out: dict[str, list] = {}
    for query, field, term, weight in zip(*(c.to_pylist() for c in asked.columns), strict=True):
        out.setdefault(query, []).append(((field, term), weight))
    return list(out.items())


def _weights_by_query(asked: pa.Table, cells: int) -> tuple[list, np.ndarray]:
    """Query terms by query, ((field, term), row), and the matrix of their weights by cell."""
    queries, fields, terms, lists = asked.combine_chunks().columns
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    cell, weight = flat.field("cell").to_numpy(), flat.field("weight").to_numpy()
    matrix = np.zeros((len(lists), cells))
    every = cell < 0
    matrix[row[every]] = weight[every][:, None]
    matrix[row[~every], cell[~every]] = weight[~every]
    out: dict[str, list] = {}
    for i, (query, field, term) in enumerate(zip(queries.to_pylist(), fields.to_pylist(), terms.to_pylist(), strict=True)):
        out.setdefault(query, []).append(((field, term), i))
    return list(out.items()), matrix


_CELL_SCORES = pa.schema([("cell", pa.int32()), ("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])


class _Shard:
    """The blocks of one shard: postings as numbers of documents and, once a query needs them, their impacts."""

    def __init__(self, table: pa.Table, impact: Impact | None):
        table = _as_blocks(table)
        entries = table.column("entries").combine_chunks()
        flat = entries.flatten()
        codes = flat.field("doc").dictionary_encode()
        self.names, self.docs = codes.dictionary, codes.indices.to_numpy()
        self.x, self.y = (flat.field(c).to_numpy() for c in "xy")
        self.starts = entries.offsets.to_numpy()
        self.starts = self.starts - self.starts[0]
        self.fields = table.column("field").to_pylist()
        self.blocks = {key: i for i, key in enumerate(zip(self.fields, table.column("term").to_pylist(), strict=True))}
        self.impact, self.impacts = impact, {}
        self.met = self.scored = 0
        self.gone: np.ndarray | None = None
        self.rank: np.ndarray | None = None
        if impact is None:
            return
        most, least, field = table.column("most").to_numpy(), table.column("least").to_numpy(), np.array(self.fields, object)
        self.bounds = np.zeros(len(most))
        for f in set(self.fields):
            self.bounds[field == f] = impact(f, most[field == f], least[field == f])

    def leave_out(self, gone: frozenset[str]) -> None:
        """Documents that must not be found: their scores never count."""
        at = np.flatnonzero([name in gone for name in self.names.to_pylist()])
        self.gone = at if len(at) else None

    def _impacts(self, block: int) -> np.ndarray:
        if block not in self.impacts:
            a, b = self.starts[block], self.starts[block + 1]
            self.impacts[block] = self.impact(self.fields[block], self.x[a:b], self.y[a:b])
        return self.impacts[block]

    def top(self, wanted: list[tuple[tuple[str, str], float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores of the ``k`` best with a positive score, and of all that tie with them."""
        found = [(w * self.bounds[b], w, b) for key, w in wanted if (b := self.blocks.get(key)) is not None]
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        signed = any(w < 0 for _, w, _ in found)  # then no sum bounds the rest
        found.sort(key=lambda t: (-t[0], t[2]))
        rest = np.append(np.cumsum([t[0] for t in found][::-1])[::-1], 0.0)
        scores, able, cut = np.zeros(len(self.names)), None, 0.0
        for i, (_, w, block) in enumerate(found):
            docs = self.docs[self.starts[block] : self.starts[block + 1]]
            self.met += len(docs)
            if able is None and not signed and cut - SLACK > rest[i]:
                able = np.zeros(len(scores), bool)
            if able is None:
                scores[docs] += w * self._impacts(block)  # a document is in a block once
                self.scored += len(docs)
            else:
                able[:] = scores + rest[i] >= cut - SLACK
                at = np.flatnonzero(able[docs])
                scores[docs[at]] += w * self._impacts(block)[at]
                self.scored += len(at)
            if self.gone is not None:
                scores[self.gone] = 0
            if not signed and k < len(scores) and i + 1 < len(found):
                cut = max(cut, np.partition(scores, len(scores) - k)[len(scores) - k])
        cut = np.partition(scores, len(scores) - k)[len(scores) - k] if k < len(scores) else 0.0
        best = np.flatnonzero((scores > 0) & (scores >= cut - SLACK))
        return best, scores[best]

    def first(self, docs: np.ndarray, scores: np.ndarray, k: int, cells: np.ndarray | int = 0) -> np.ndarray:
        """Which to keep: of documents with exactly equal scores (in one of ``cells``) the ``k`` with the least ids: no other one of these can
        be among the best."""
        if len(docs) <= k:
            return np.arange(len(docs))
        if self.rank is None:
            self.rank = np.empty(len(self.names), np.int64)
            self.rank[pc.sort_indices(self.names).to_numpy()] = np.arange(len(self.names))
        cells = np.broadcast_to(cells, len(docs))
        order = np.lexsort((self.rank[docs], scores, cells))
        new = np.append(True, (scores[order][1:] != scores[order][:-1]) | (cells[order][1:] != cells[order][:-1]))
        at = np.arange(len(order))
        return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])

    def top_of_cells(self, wanted: list[tuple[tuple[str, str], int]], weights: np.ndarray, impacts: Callable, cells: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cell, document (number) and score of the ``k`` best of each cell with a positive score, and of ties."""
        found = [(row, b) for key, row in wanted if (b := self.blocks.get(key)) is not None]
        if not found:
            return (np.empty(0, np.int64),) * 3
        own = np.unique(np.concatenate([self.docs[self.starts[b] : self.starts[b + 1]] for _, b in found]))
        place = np.empty(len(self.names), np.int64)
        place[own] = np.arange(len(own))
        scores = np.zeros((len(own), cells))
        step = max(1, PRODUCTS // cells)
        for row, b in found:
            for i in range(self.starts[b], self.starts[b + 1], step):
                j = min(i + step, self.starts[b + 1])
                scores[place[self.docs[i:j]]] += impacts(self.fields[b], self.x[i:j], self.y[i:j]) * weights[row]
        scores = np.round(scores, DECIMALS)
        cut = np.partition(scores, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(cells, -np.inf)
        at, cell = np.nonzero((scores >= cut) & (scores > 0))
        return cell, own[at], scores[at, cell]
