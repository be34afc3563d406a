"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed, code point by code point, into the phrases of an LZ78 dictionary: each phrase is
the shortest string not yet in it.  Every phrase is hashed to 32 bits; the fingerprint is the
:data:`SIZE` smallest hashes, ascending, eight hexadecimal digits each.  The likeness of two
fingerprints is the share of common values among the smallest :data:`SIZE` of their union, an
estimate of the Jaccard similarity of the phrase sets (exact when the sets are smaller).

Defined cases: a null text counts as empty; the empty text has the empty fingerprint, which is like
itself (1.0) and unlike any other (0.0).  Equal texts have equal fingerprints, and rows that repeat are
rows of their own.  An empty table gives no rows; a single row is the next one to itself.  A very long
text is parsed whole by one task, which holds one document's dictionary at a time.  Columns beyond the id
and the text, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

#: Smallest hashes that a fingerprint keeps.
SIZE = 128
#: Documents in a run of neighbouring ids, and the most runs that boundaries are kept for.
RUN_ROWS = 100
MOST_RUNS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NO_ID = -(1 << 63)


def _grow(phrases: dict, text: str) -> dict:
    phrase = ""
    for c in text:
        phrase += c
        if phrase not in phrases:
            phrases[phrase] = None
            phrase = ""
    return phrases


def _smallest_hashes(phrases: dict) -> np.ndarray:
    """The smallest hashes of distinct phrases."""
    if not phrases:
        return np.empty(0, np.uint32)
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    points = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _BASE
    np.cumprod(powers, out=powers)
    within = np.arange(len(points)) - np.repeat(starts, lengths)
    h = np.add.reduceat((points.astype(np.uint64) + np.uint64(1)) * powers[within], starts)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * SIZE:
        h = np.partition(h, 2 * SIZE)[: 2 * SIZE + 1]
    return np.unique(h)[:SIZE]


def signature(text: str | None) -> np.ndarray:
    """The fingerprint of a text as an ascending array."""
    return _smallest_hashes(_grow({}, text or ""))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the smallest of the union of two fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    nth = np.arange(1, len(both)) + 1 - np.cumsum(twice)  # distinct values up to each position
    distinct = min(SIZE, int(nth[-1]))
    return float(np.count_nonzero(twice & (nth <= SIZE))) / distinct


def to_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def _both(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text and the fingerprints of both; what the texts share is parsed once."""
    k = len(text) // 3
    head = len(text) - k
    edited = text[:head] + following[:k]
    phrases = _grow({}, text)
    own = _smallest_hashes(phrases)
    if edited == text:
        return edited, own, own
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    n = int(np.searchsorted(ends, head, side="right"))
    again = dict.fromkeys(islice(phrases, n))
    _grow(again, edited[int(ends[n - 1]) if n else 0 :])
    return edited, own, _smallest_hashes(again)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id and ``fingerprint`` of every row of ``docs``."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [to_text(signature(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    out = common.map_arrow(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), run, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_column)


def _runs(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of runs of neighbouring ids, and the largest id in each run that has one."""
    n = ids.count()
    runs = min(MOST_RUNS, max(1, n // RUN_ROWS))
    cuts = ids.select(F.percentile_approx("id", [i / runs for i in range(1, runs)], 10 * runs)).first()[0] if runs > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(cuts) + 1, _NO_ID, np.int64)
        met = np.zeros(len(cuts) + 1, bool)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, x)
            np.maximum.at(most, at, x)
            met[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met)), pa.array(most[met])], ["run", "most"])

    rows = ids.mapInArrow(largest, "run long, most long").groupBy("run").agg(F.max("most").alias("most")).collect()
    most = np.full(len(cuts) + 1, _NO_ID, np.int64)
    met = np.zeros(len(cuts) + 1, bool)
    for r in rows:
        most[r.run], met[r.run] = r.most, True
    return cuts, np.where(met, most, np.int64(_NO_ID)) if met.all() else _filled(most, met)


def _filled(most: np.ndarray, met: np.ndarray) -> np.ndarray:
    """A run without ids takes the largest id of the next lower run that has one."""
    last = most[met][-1] if met.any() else _NO_ID
    for i in range(len(most)):
        if met[i]:
            last = most[i]
        else:
            most[i] = last
    return most


def with_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, in descending order of an integer id.

    The edited text has its last third (rounded down) replaced by as many first code points of the
    next text, or all of it; after the last row comes the first.  Rows with equal ids follow each
    other by text, in one task; a null id comes last.  Columns: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Rows are dealt out by runs of neighbouring ids, each run with a copy of the first row of the
    run after it, so texts are moved once and every task streams through its rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    cuts, most = _runs(rows.select(F.coalesce("id", F.lit(_NO_ID)).alias("id")))
    last = len(most) - 1
    before = {}  # the largest id of a run to the run that ends with it
    for i in range(len(most)):
        if i == 0 or most[i] != most[i - 1]:
            before.setdefault(int(most[i]), []).append(i + 1 if i < last else 0)
    keys = np.array(sorted(before), np.int64)
    # A run that shares its largest id with the one below has no ids: its own rows are none.
    target = {k: v[0] for k, v in before.items()}
    occupied = np.array([i == 0 or most[i] != most[i - 1] for i in range(len(most))])
    for k, t in target.items():
        while t and not occupied[t]:
            t = t + 1 if t < last else 0
        target[k] = t
    to = np.array([target[int(k)] for k in keys], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            run = np.searchsorted(cuts, ids)
            at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
            edge = np.flatnonzero(keys[at] == ids)
            for which, runs, copy in ((np.arange(len(ids)), run, False), (edge, to[at[edge]], True)):
                if len(which):
                    part = batch.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([pa.array(runs.astype(np.int64)), pa.array(np.full(len(which), copy)), *part.columns], ["run", "copy", "id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for the next one: run, id, text
        waiting: list = []  # results whose near_next isn't known yet

        def close(text: str, out: list) -> None:
            """The row that waits has met the text that follows it."""
            nonlocal held
            _, row_id, own = held
            edited, a, b = _both(own, text)
            if waiting:
                out.append((*waiting.pop(), likeness(waiting_print.pop(), a)))
            waiting.append((row_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_text(a), to_text(b), likeness(a, b)))
            waiting_print.append(a)
            held = None

        waiting_print: list = []
        for batch in batches:
            out: list = []
            for run, copy, row_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copy:
                    if held is not None and held[0] == run:
                        close(text, out)
                        out.append((*waiting.pop(), likeness(waiting_print.pop(), signature(text))))
                    continue
                if held is not None:
                    close(text, out)
                held = (run, row_id, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    dealt = rows.mapInArrow(deal, "run long, copy boolean, id long, text string")
    order = (F.col("run"), F.col("copy"), F.desc_nulls_last("id"), F.col("text"))
    out = dealt.repartition(common.shuffle_width(spark), "run").sortWithinPartitions(*order).mapInArrow(walk, _SCHEMA)
    return out.withColumnRenamed("id", id_column)


_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_edited(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_lz_fingerprint": op1_lz_fingerprint}
