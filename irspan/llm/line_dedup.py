"""Lines that many documents share, found by a sorted stream of hashes.

Every line with a long enough key (stripped, A-Z lower-cased) is a record of 128 bits of its key's hash,
its document and its position; text is not moved.  Records are dealt by ranges of (hash, document,
position) and sorted so, largest document first.  A task streams its range: within a hash the first
document keeps its lines, and once :data:`DOCUMENTS` documents were met, all later lines are dropped.
Ranges may begin and end inside a hash, so a line of a third of all documents is in many tasks; the first
hash of a range, and the last one where it is short of documents, are left open, and what each range saw of
them (two hashes a range at most) is put together afterwards.  Dropped positions come back as one
compressed bitmap a document, and only those are joined with the texts.

Defined cases: a null or empty text is one empty line, which has no key.  A document is what has one id:
rows that share an id count once and keep or lose a line together, whether their texts are equal or not.
Rows without an id count as one document before all others.  Equal lines of one document share their fate.
An empty table gives no rows.  A very long text is split whole, and its bitmap is one row.  Extra columns,
whatever their names, go along with :func:`cleaned`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from irspan.llm import common

#: Code points of a key that counts, and documents that must hold it.
KEY_CHARS, DOCUMENTS = 40, 5
#: What is stripped at both ends of a line.
SPACES = b" \t\n\x0b\x0c\r"

_DROP, _OPEN, _EDGE = range(3)
_RECORD = ["h1", "h2", "unknown", "doc", "text_key", "n_lines", "pos"]
_RECORD_SCHEMA = ", ".join(f"{c} long" for c in _RECORD)
_STREAM = [*_RECORD, "state", "inner"]


def _keyed_lines(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Lines of each text; then row, position and hash of every line whose key has ``least`` code points."""
    counts, rows, places, digests = [], [], [], []
    digest = xxhash.xxh3_128_digest
    for r, text in enumerate(texts):
        lines = text.split(b"\n")
        counts.append(len(lines))
        for i, line in enumerate(lines):
            if len(line) < least:
                continue
            key = line.strip(SPACES).lower()
            n = len(key)
            if n < 4 * least and (n < least or len(key.decode("utf-8", "replace")) < least):
                continue
            rows.append(r)
            places.append(i)
            digests.append(digest(key))
    return np.array(counts, np.int64), np.array(rows, np.int64), np.array(places, np.int64), digests


def line_records(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", least: int = KEY_CHARS) -> DataFrame:
    """A record of hash, document, text and position for every line that may be dropped.  No shuffle."""
    common.small_batches(docs.sparkSession)
    id_ = F.col(id_column).cast("long")
    rows = docs.select(F.coalesce(text_column, F.lit("")).alias("text"), F.isnull(id_).cast("long").alias("unknown"), F.coalesce(id_, F.lit(0)).alias("doc"), _text_key(text_column).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 0):
                counts, at, pos, digests = _keyed_lines(part.column(0).cast(pa.binary()).to_pylist(), least)
                if not len(at):
                    continue
                hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                own = [part.column(i).to_numpy()[at] for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in (hashes[:, 0], hashes[:, 1], *own, counts[at], pos)], names=_RECORD)
        common.trim()

    return rows.mapInArrow(run, _RECORD_SCHEMA)


def _text_key(text_column: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text_column, F.lit("")))


@dataclass
class _Run:
    """The records of one hash that a stream has met so far; ``head``: they may have begun in another range."""

    head: bool
    first: tuple[int, int]
    last: tuple[int, int]
    documents: int = 0
    waiting: list[np.ndarray] = field(default_factory=list)


class _Stream:
    """Decides the sorted records of one range; ``out`` has what is to be sent on."""

    def __init__(self, documents: int):
        self.least, self.run, self.key, self.out = documents, None, None, []

    def _send(self, rows: np.ndarray, state: int) -> None:
        if len(rows):
            extra = np.empty((len(rows), 2), np.int64)
            extra[:, 0], extra[:, 1] = state, 0
            self.out.append(np.hstack([rows, extra]))

    def _extend(self, rows: np.ndarray, new_documents: int) -> None:
        """More records of the open run."""
        run = self.run
        run.documents += new_documents
        run.last = (rows[-1, 2], rows[-1, 3])
        if run.head:
            self._send(rows, _OPEN)
            return
        run.waiting.append(rows)
        if run.documents >= self.least:
            met = np.vstack(run.waiting)
            self._send(met[(met[:, 2] != run.first[0]) | (met[:, 3] != run.first[1])], _DROP)
            run.waiting = []

    def _edge(self) -> None:
        """What this range saw of the open run: its outer documents, and how many are between them."""
        run = self.run
        outer = {run.first, run.last}
        for i, (unknown, doc) in enumerate(sorted(outer)):
            self.out.append(np.array([[*self.key, unknown, doc, 0, 0, 0, _EDGE, 0 if i else run.documents - len(outer)]], np.int64))

    def add(self, rows: np.ndarray) -> None:
        """The next records, in order."""
        keys, docs = rows[:, :2], rows[:, 2:4]
        new_key = np.ones(len(rows), bool)
        new_key[1:] = (keys[1:] != keys[:-1]).any(1)
        new_doc = new_key.copy()
        new_doc[1:] |= (docs[1:] != docs[:-1]).any(1)
        if self.run is not None and self.key == tuple(keys[0]):
            new_key[0] = False
            new_doc[0] = self.run.last != tuple(docs[0])
        starts = np.flatnonzero(new_key)
        head = starts[0] if len(starts) else len(rows)
        if head:
            self._extend(rows[:head], int(new_doc[:head].sum()))
        if not len(starts):
            return
        begun = self.run is None
        if not begun and self.run.head:
            self._edge()
        whole = starts[1:-1] if begun else starts[:-1]
        if len(whole):
            lo, hi = whole[0], starts[-1]
            documents = np.cumsum(new_doc[lo:hi])
            sizes = np.diff(np.append(whole, hi))
            before = np.repeat(documents[whole - lo], sizes)
            met = np.repeat(np.add.reduceat(new_doc[lo:hi].astype(np.int64), whole - lo), sizes)
            self._send(rows[lo:hi][(met >= self.least) & (documents > before)], _DROP)
        if begun and len(starts) > 1:
            self._open(rows[: starts[1]], new_doc[: starts[1]], True)
            self._edge()
            begun = False
        self._open(rows[starts[-1] :], new_doc[starts[-1] :], begun)

    def _open(self, rows: np.ndarray, new_doc: np.ndarray, head: bool) -> None:
        first = (rows[0, 2], rows[0, 3])
        self.key, self.run = tuple(rows[0, :2]), _Run(head, first, first)
        self._extend(rows, int(new_doc.sum()))

    def end(self) -> None:
        """No more records in this range."""
        if self.run is not None:
            self._edge()
            for rows in self.run.waiting:
                self._send(rows, _OPEN)

    def taken(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        if out:
            rows = np.vstack(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1])], names=_STREAM)


def dropped_lines(records: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The records of :func:`line_records` (a written table: they are read twice) that lose their lines.

    One shuffle, by range.  Ranges are put together by a table of two hashes a partition at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(documents)
        for batch in batches:
            if batch.num_rows:
                stream.add(np.column_stack([batch.column(i).to_numpy() for i in range(len(_RECORD))]))
                yield from stream.taken()
        stream.end()
        yield from stream.taken()

    order = ["h1", "h2", "unknown", F.col("doc").desc(), "pos"]
    ranges = records.repartitionByRange(common.shuffle_width(records.sparkSession), *order).sortWithinPartitions(*order)
    seen = common.written(ranges.mapInArrow(run, ", ".join(f"{c} long" for c in _STREAM)), "line_stream")
    known = F.struct(-F.col("unknown"), F.col("doc"))
    edges = seen.where(F.col("state") == _EDGE).groupBy("h1", "h2").agg((F.sum("inner") + F.count_distinct(known)).alias("documents"), F.max(known).alias("largest"))
    verdicts = F.broadcast(edges.where(F.col("documents") >= documents).select("h1", "h2", "largest"))
    late = seen.where(F.col("state") == _OPEN).join(verdicts, ["h1", "h2"]).where(known != F.col("largest"))
    return seen.where(F.col("state") == _DROP).select(*_RECORD).unionByName(late.select(*_RECORD))


def pack_bits(n: int, dropped: np.ndarray) -> bytes:
    """Compressed bits of ``n`` lines, 1 where a line stays."""
    keep = np.ones(n, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bits(n: int, packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", least: int = KEY_CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_lines``, ``n_dropped`` and ``keep`` (compressed bits) of every document,
    told apart by id and text, that loses a line; all others keep theirs."""
    records = common.written(line_records(docs, text_column, id_column, least), "line_records")
    by_doc = dropped_lines(records, documents).groupBy("unknown", "doc", "text_key", "n_lines").agg(F.collect_set("pos").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.array(x, np.int64) for x in b.column(4).to_pylist()]
            doc = pa.array([None if u else d for u, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.int64())
            keep = [pack_bits(n, x) for n, x in zip(b.column(3).to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays([doc, b.column(2), b.column(3), pa.array(map(len, at), pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    return by_doc.mapInArrow(run, "doc_id long, text_key long, n_lines long, n_dropped long, keep binary")


def cleaned(docs: DataFrame, bitmaps: DataFrame, text_column: str = "text", id_column: str = "doc_id", count: str | None = None) -> DataFrame:
    """``docs`` with the lines that ``bitmaps`` drops taken out of their texts, and with the column ``count``
    of how many those are, if named; a null text becomes empty."""
    common.small_batches(docs.sparkSession)
    right = bitmaps.select(F.col("doc_id").alias("id"), "text_key", F.struct("n_lines", "n_dropped", "keep").alias("bits"))
    left = docs.select(*(F.coalesce(c, F.lit("")).alias(c) if c == text_column else F.col(c) for c in docs.columns))
    same = F.col(f"l.{id_column}").cast("long").eqNullSafe(F.col("r.id")) & (_text_key(f"l.{text_column}") == F.col("r.text_key"))
    n, at, names = len(docs.columns), docs.columns.index(text_column), docs.columns + [count] * bool(count)
    rows = left.alias("l").join(right.alias("r"), same, "left").select(*(F.col(f"l.{c}") for c in docs.columns), *([F.coalesce("r.bits.n_dropped", F.lit(0).cast("long")).alias(count)] if count else []), F.col("r.bits").alias(common.fresh(docs, "bits")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, at):
                texts, bits = part.column(at), part.column(len(names))
                if bits.null_count < len(bits):
                    texts = pa.array([t if b is None else _kept(t, b) for t, b in zip(texts.to_pylist(), bits.to_pylist(), strict=True)], texts.type)
                yield pa.RecordBatch.from_arrays([texts if i == at else part.column(i) for i in range(len(names))], names=names)
        common.trim()

    return rows.mapInArrow(run, StructType([*docs.schema.fields, *([StructField(count, LongType())] if count else [])]))


def _kept(text: str, bits: dict) -> str:
    keep = unpack_bits(bits["n_lines"], bits["keep"])
    return "\n".join([x for x, k in zip(text.split("\n"), keep, strict=True) if k])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped, and the digest of what stays, for every document."""
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    bitmaps = common.written(keep_bitmaps(docs), "keep_bitmaps")
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    return cleaned(counted, bitmaps, count="n_dropped").select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op12_line_dedup": op12_line_dedup}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op12_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
shared AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= {KEY_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {DOCUMENTS}),
m AS (SELECT k.*, shared.key IS NOT NULL AND k.doc_id IS DISTINCT FROM largest AS dropped FROM k LEFT JOIN shared USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r""",
}
