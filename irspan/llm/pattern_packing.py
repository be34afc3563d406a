"""Best-fit packing of documents into sequences by patterns of lengths.

Texts become token ids, a separator behind each document; documents longer than a sequence are cut
into full pieces, the remainder first.  Lengths alone decide the packing: their histogram (one count
for each length, however large the corpus) goes to the driver.  Patterns of up to three length bins
that fill a sequence are enumerated, and longer ones added by what the histogram has left; their repeat
counts are fitted to the binned histogram by non-negative least squares and rounded down; a pattern
is used as often as exact lengths of its bins fill a sequence, and what is left is packed best fit, longest
first.  Leaving the shortest documents to that rest is tried too, and the plan of fewest sequences taken;
plain best fit is compared last, so none takes more.  The plan is a few thousand entries (lengths, repeats).  Pieces take their places by rank among those of their length; ranks come from
buckets of bounded size, so no length is gathered in one task.

Defined cases: a null or empty text is the separator alone; rows that repeat, and rows with equal or null
ids, are separate documents; an empty table gives no pieces; a very long text is encoded whole by one
task, long runs of white space by the rule of :mod:`byte_bpe`; the strings of special tokens are
ordinary text.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irspan.llm import common
from irspan.llm.byte_bpe import encode_text, encoding, has_long_space, vocabulary_path

#: Tokens of a sequence, and the id behind each document.
SEQUENCE, SEPARATOR = 2048, 0
#: Width of the length bins that patterns are made of, documents in the patterns that are enumerated,
#: and how often patterns of any number of documents are added by what is left of the histogram.
BIN, PATTERN_DOCS, ROUNDS = 16, 3, 8
#: Documents of up to so many bins are left out of patterns, for the rest to be filled up with; each is tried.
LEAST_BINS = (0, 8, 16, 32)
#: Pieces of a length are ranked in buckets of about so many, and in so many buckets at most over all.
BUCKET_ROWS, MOST_BUCKETS = 256, 20_000
#: Words that a worker remembers the ids of.
CACHE_WORDS = 100_000

_ODD_SPACE = re.compile(r" \s| \Z")
#: Characters beyond these go to the tokenizers library itself, whose character classes are its own.
_BEYOND = re.compile("[^\x00-ɏ‐-‧€]")


class Tokenizer:
    """Ids of texts as little-endian 32-bit bytes, the same as the tokenizer file gives.

    A space before a character that isn't white space always begins a pre-token, so words are
    encoded apart: those not met before are encoded together and cut apart again at the tokens that
    begin with a space.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.json_path, self.words = json_path, {}
        self.encoding = encoding(ranks_path, pattern)
        self.spaced = np.array([self.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.encoding.max_token_value + 1)])
        self.whole = None

    def _exact(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer as Whole

            self.whole = Whole.from_file(self.json_path)
            self.whole.encode_special_tokens = True
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        split: list = []
        fresh: set[str] = set()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = self.words
        for t in texts:
            if not t.isascii() and _BEYOND.search(t) or _ODD_SPACE.search(t) or has_long_space(t):
                split.append(None)
                continue
            parts = t.split(" ")
            split.append(parts)
            fresh.update(parts[1:])
        fresh = [w for w in fresh if w not in words]
        for at in range(0, len(fresh), 20_000):
            block = fresh[at : at + 20_000]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(block)), "<u4")
            starts = np.flatnonzero(self.spaced[ids]) * 4
            if len(starts) != len(block):
                raise AssertionError("a word isn't apart")
            data = ids.tobytes()
            ends = [*starts[1:].tolist(), len(data)]
            words.update(zip(block, [data[a:b] for a, b in zip(starts.tolist(), ends, strict=True)], strict=True))
        get = words.__getitem__
        out = []
        for t, parts in zip(texts, split, strict=True):
            if parts is None:
                out.append(self._exact(t) if _BEYOND.search(t) else np.array(encode_text(t, self.encoding), "<u4").tobytes())
            else:
                out.append(np.array(self.encoding.encode_ordinary(parts[0]), "<u4").tobytes() + b"".join(map(get, parts[1:])))
        return out


@lru_cache(maxsize=1)
def tokenizer(json_path: str, ranks_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(json_path, ranks_path, pattern)


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Columns id, piece, start, length and ids_crc32 of every piece; no shuffle."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    names = ["id", "piece", "start", "length", "ids_crc32"]
    end = np.array([SEPARATOR], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        found = tokenizer(json_path, ranks_path, pattern).encode([t or "" for t in batch.column(1).to_pylist()])
        for row_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
            ids += end
            n = len(ids) // 4
            first = n if n <= sequence else (n - 1) % sequence + 1
            if first == n:
                rows.append((row_id, 0, 0, n, zlib.crc32(ids)))
                continue
            view = memoryview(ids)
            for k, start in enumerate([0, *range(first, n, sequence)]):
                stop = start + sequence if k else first
                rows.append((row_id, k, start, stop - start, zlib.crc32(view[4 * start : 4 * stop])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return common.map_arrow(rows, run, "id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    gram, gradient = a.T @ a, a.T @ b
    moments = gradient.copy()
    limit = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gradient = moments - gram[:, active] @ x[active]
        gradient[active] = 0
        j = int(gradient.argmax())
        if gradient[j] <= limit:
            break
        active.append(j)
        while True:
            try:
                z = np.linalg.solve(gram[np.ix_(active, active)], moments[active])
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if z.min() > 0:
                break
            now = x[active]
            low = z <= 0
            step = float((now[low] / np.maximum(now[low] - z[low], 1e-300)).min())
            now = now + step * (z - now)
            keep = now > 1e-12
            keep[-1] &= bool(z[-1] > 0)
            x[:] = 0
            active = [k for k, yes in zip(active, keep, strict=True) if yes]
            x[active] = now[keep]
            if not active:
                return x
        x[:] = 0
        x[active] = z
    return x


@dataclass
class Plan:
    """Entries (lengths, repeats): that many sequences with these lengths in this order."""

    entries: list[tuple[tuple[int, ...], int]]

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.entries)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run of ranks of a length: length and first rank as one key, the first rank's
        sequence less the rank, and the place in the sequence."""
        used: dict[int, int] = {}
        rows = []
        base = 0
        for lengths, n in self.entries:
            at = 0
            for length in lengths:
                rank = used.get(length, 0)
                rows.append(((length << 44) + rank, base - rank, at))
                used[length] = rank + n
                at += length
            base += n
        rows.sort()
        return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3


def _take(counts: np.ndarray, lengths: list[int]) -> int:
    """How often these lengths can be taken together."""
    need: dict[int, int] = {}
    for x in lengths:
        need[x] = need.get(x, 0) + 1
    return min(int(counts[x]) // n for x, n in need.items())


def best_patterns(worth: np.ndarray) -> list[tuple[int, ...]]:
    """For each length bin the pattern of most worth that has a document of it, with as many documents
    as fit (an unbounded knapsack); ``worth``: of a document of bin 1, 2, ..., as many as fill a sequence."""
    bins = len(worth)
    some = [i + 1 for i in range(bins) if worth[i] > 0]
    best, pick = np.zeros(bins + 1), np.zeros(bins + 1, np.int64)
    for room in range(1, bins + 1):
        best[room] = best[room - 1]
        for i in some:
            if i > room:
                break
            if best[room - i] + worth[i - 1] > best[room] + 1e-9:
                best[room], pick[room] = best[room - i] + worth[i - 1], i
    out = []
    for first in some:
        pattern, room = [first], bins - first
        while room:
            if pick[room]:
                pattern.append(int(pick[room]))
                room -= int(pick[room])
            else:
                room -= 1
        out.append(tuple(sorted(pattern)))
    return out


def fitted_patterns(binned: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of length bins and how often to use each, by non-negative least squares on a histogram
    of bins.

    Begins with all patterns of up to :data:`PATTERN_DOCS` documents that fill a sequence, and adds, for
    :data:`ROUNDS` times, those of any number of documents that the rest of the histogram calls for.
    """
    bins = len(binned)
    some = [i + 1 for i in range(bins) if binned[i]]
    found = dict.fromkeys(p for k in range(1, PATTERN_DOCS + 1) for p in combinations_with_replacement(some, k) if sum(p) == bins)
    rest, repeats = binned, np.zeros(0)
    for _ in range(ROUNDS):
        before = len(found)
        found.update(dict.fromkeys(best_patterns(rest)))
        if len(found) == before:
            break
        matrix = np.zeros((bins, len(found)))
        for j, p in enumerate(found):
            np.add.at(matrix[:, j], np.array(p) - 1, 1)
        repeats = nnls(matrix, binned)
        rest = binned - matrix @ repeats
    return [(p, n) for p, n in zip(found, np.floor(repeats + 1e-6).astype(np.int64).tolist(), strict=False) if n]


def _packed(counts: np.ndarray, patterns: list[tuple[tuple[int, ...], int]], sequence: int, width: int) -> Plan:
    """Use the patterns as often as exact lengths fill a sequence, then pack the rest best fit, longest first."""
    counts = counts.copy()
    entries: list[tuple[tuple[int, ...], int]] = []

    def enter(lengths: list[int], most: int | None = None) -> int:
        """Enter as many sequences of these lengths as the counts allow."""
        n = _take(counts, lengths)
        n = n if most is None else min(n, most)
        for x in lengths:
            counts[x] -= n
        entries.append((tuple(lengths), n))
        return n

    def exact(bins: list[int], taken: list[int]) -> list[int] | None:
        """Lengths of the bins, the last of which fills the sequence; only the last three are varied."""
        if len(taken) == len(bins) - 1:
            rest = sequence - sum(taken)
            return [*taken, rest] if rest > 0 and counts[rest] > taken.count(rest) else None
        low = (bins[len(taken)] - 1) * width + 1
        found = (np.flatnonzero(counts[low : low + width]) + low)[::-1].tolist()
        for x in found if len(taken) >= len(bins) - 3 else found[:1]:
            if counts[x] > taken.count(x) and (out := exact(bins, [*taken, x])):
                return out
        return None

    if counts[sequence]:
        enter([sequence])
    for pattern, left in sorted(patterns, key=lambda x: (-x[1], x[0])):
        bins = sorted(pattern, reverse=True)
        while left > 0 and (lengths := exact(bins, [])):
            left -= enter(lengths, left)
    while len(some := np.flatnonzero(counts)):
        lengths, room = [int(some[-1])], sequence - int(some[-1])
        while room > 0 and (x := next((x for x in some[: np.searchsorted(some, room, side="right")][::-1].tolist() if counts[x] > lengths.count(x)), 0)):
            lengths.append(x)
            room -= x
        enter(lengths)
    return Plan(entries)


def make_plan(histogram: dict[int, int], sequence: int = SEQUENCE, width: int = BIN) -> Plan:
    """Pack a histogram of lengths: of the plans that :data:`LEAST_BINS` give, and plain best fit, the first of
    those with the fewest sequences."""
    counts = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = -(-sequence // width)
    bin_of = (np.arange(sequence) + width - 1) // width
    fewest = -(-int((counts * np.arange(sequence + 1)).sum()) // sequence)
    best: Plan | None = None
    for least in (*LEAST_BINS, None):
        patterns = []
        if least is not None:
            binned = np.bincount(bin_of, np.where(bin_of > least, counts[:sequence], 0), minlength=bins + 1)[1 : bins + 1]
            patterns = fitted_patterns(binned.astype(float))
        plan = _packed(counts, patterns, sequence, width)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == fewest:
            break
    return best


def pack(found: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Give the pieces (column length, and any others) their sequence_id and offset.

    ``found`` must come out alike each time that it is read: pass a checkpoint.
    """
    lengths = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = make_plan(lengths, sequence).places()
    size = max(BUCKET_ROWS, -(-sum(lengths.values()) // MOST_BUCKETS))
    spark = found.sparkSession
    split = spark.createDataFrame([(k, -(-n // size)) for k, n in lengths.items()], "length long, buckets long")
    columns = found.columns
    row = found.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(split), "length")  # at most one row a length
    row = row.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    sizes = row.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect()  # about MOST_BUCKETS at most
    before: dict[int, int] = {}
    bases = []
    for r in sorted(sizes):
        bases.append((r.length, r.bucket, before.get(r.length, 0)))
        before[r.length] = before.get(r.length, 0) + r.n
    bases = spark.createDataFrame(bases, "length long, bucket long, base long")
    ranked = row.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1).join(F.broadcast(bases), ["length", "bucket"])
    ranked = ranked.select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    at = columns.index("length")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases_of, offsets = places
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, len(columns)))
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bases_of[k] + rank), pa.array(offsets[k])], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Cut and pack the documents with the public 50k byte-level vocabulary, or another one."""
    import public_tokenizers

    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")
    found = common.checkpointed(pieces(docs, json_path, ranks_path, public_tokenizers.PATTERN, id_column, text_column))
    return pack(found).withColumnRenamed("id", id_column)


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(common.spread(common.table(spark, sf_dir, "documents")))


QUERIES = {"op7_pattern_packing": op7_pattern_packing}
