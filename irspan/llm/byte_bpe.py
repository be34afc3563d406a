"""Byte-level BPE encoding and decoding of whole texts.

Every text longer than :data:`CHUNK` characters is cut into chunks that overlap, and each chunk is
pre-tokenised by itself.  A boundary that two neighbouring chunks both find in their overlap is where
they resynchronise: matching goes from left to right and depends on nothing before a boundary, so from
there on both are the same.  The text is cut at these places and the pieces are encoded.  Where
neighbours have no common boundary, one match is longer than the overlap, and it is followed to its
end.  A text of over :data:`TASK` characters has parts of that length, with an overlap of their own,
pre-tokenised and encoded in different tasks; parts that never agree are put together again and
chunked in one task.  Decoding concatenates the raw bytes of the ids.

A run of white space before a word is one pre-token but for its last character.  Runs from
:data:`LONG_SPACE` on are cut off by that rule and merged as bytes, since the library's pattern matcher
runs out of stack on very long ones.

Defined cases: null and empty texts have no tokens; an empty table gives no rows; the decoded bytes
are the UTF-8 of the text.  Equal rows give equal rows.  A text of one pre-token, however long, is one
piece.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irspan.llm import common

#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 10, 1 << 7
#: Characters of a part of a text that a task of its own works on, and of the overlap of parts.
TASK, TASK_OVERLAP = 1 << 16, 1 << 11
#: Characters of white space from which a run is cut off before the library sees it.
LONG_SPACE = 1 << 12
#: A boundary this close to a chunk's end may depend on what follows; it isn't used.
MARGIN = 64


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; read once by each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _decimals(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(path, pattern).max_token_value + 1)]


@lru_cache(maxsize=4)
def _compiled(pattern: str) -> regex.Pattern:
    """The pattern with the library's white space: the property, without the information separators."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))


def boundaries(text: str, pattern: str, start: int = 0, stop: int | None = None) -> list[int]:
    """Where pre-tokens of a part of a text start, counted from the part's start: those where a text
    may be cut.  Behind white space it may not, as matching looks ahead from there."""
    found = _compiled(pattern).finditer(text, start, len(text) if stop is None else stop)
    return [m.start() - start for m in found if m.start() == start or text[m.start() - 1] not in _SPACES]


# The characters with the property White_Space.
WHITE_SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{{LONG_SPACE},}}")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c))


def has_long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and _LONG_RUN.search(text) is not None


def encode_text(text: str, encoder: tiktoken.Encoding) -> list[int]:
    """Ids of a text, with long runs of white space cut off first.

    A run is one pre-token up to its last character, which belongs to the word behind it; at the end
    of the text it is one pre-token as a whole.
    """
    if len(text) < LONG_SPACE:
        return encoder.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _LONG_RUN.finditer(text):
        out += encoder.encode_ordinary(text[at : run.start()])
        at = run.end() - (run.end() < len(text))
        out += encoder._encode_single_piece(text[run.start() : at].encode())
    return out + encoder.encode_ordinary(text[at:])


def chunk_cuts(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Boundaries where the overlapping chunks of a text agree, the first of each overlap."""
    cuts: list[int] = []
    known: list[int] = []  # boundaries of the chunk before, from where it agreed with its own predecessor
    last = 0
    for start in range(0, len(text), chunk):
        stop = min(len(text), start + chunk + overlap)
        safe = stop - MARGIN if stop < len(text) else stop
        if start >= last:
            found = [start + b for b in boundaries(text, pattern, start, stop)]
            agreed = set(known).intersection(b for b in found if start < b <= start + overlap) if start else {0}
            if agreed:
                at = min(agreed)
            else:  # follow the matches from the last boundary
                matches = _compiled(pattern).finditer(text, last)
                at = next((m.start() for m in matches if m.start() > start and text[m.start() - 1] not in _SPACES), len(text))
                if at >= safe:
                    known, last = [], at
                    if at < len(text):
                        cuts.append(at)
                    continue
                found = [at + b for b in boundaries(text, pattern, at, stop)]
            if start:
                cuts.append(at)
            known = [b for b in found if at <= b < safe]
            last = known[-1] if known else at
    return cuts


def encode_pieces(pieces: list[str], path: str, pattern: str) -> list[int]:
    """Ids of consecutive pieces that were cut at boundaries."""
    encoder = encoding(path, pattern)
    return [i for piece in pieces for i in encode_text(piece, encoder)]


def encode_chunked(text: str, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text, by chunks where it is longer than one."""
    if len(text) <= chunk:
        return encode_text(text, encoding(path, pattern))
    cuts = [0, *chunk_cuts(text, pattern, chunk, overlap), len(text)]
    return encode_pieces([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], path, pattern)


def _digests(ids: list[int], path: str, pattern: str) -> tuple[int, str, str]:
    decimal = _decimals(path, pattern)
    decoded = encoding(path, pattern).decode_bytes(ids)
    return len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@dataclass(frozen=True)
class Cutting:
    """Lengths of chunks, of parts that have a task of their own, and of their overlaps."""

    chunk: int = CHUNK
    overlap: int = OVERLAP
    task: int = TASK
    task_overlap: int = TASK_OVERLAP


def cut_parts(docs: DataFrame, path: str, pattern: str, cutting: Cutting = Cutting()) -> DataFrame:
    """Pieces of long texts: columns key, id, n (the piece's place), whole, piece and ids.

    ``docs`` has the columns id and text; repeated rows keep apart by a key of their own.  The ids are
    those of the piece; where parts of a text do not agree, its rows are ``whole`` and have none.
    """
    spark, task, overlap = docs.sparkSession, cutting.task, cutting.task_overlap

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, start in enumerate(range(0, len(text), task)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key, pa.int64()), (row_id, pa.int64()), (n, pa.int64()), (start, pa.int64()), (text[start : start + task + overlap], pa.string()))], ["key", "id", "n", "start", "text"])

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        head, tail = [], []
        for start, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            found = boundaries(text, pattern)
            head.append([start + b for b in found if 0 < b <= overlap])
            tail.append([start + b for b in found if task <= b < len(text) - MARGIN])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], ["key", "id", "n", "start", "text", "head", "tail"])

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
        ids = [None if whole else np.array(encode_chunked(piece, path, pattern, cutting.chunk, cutting.overlap), "<u4").tobytes() for whole, piece in rows]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["key", "id", "n", "whole", "piece", "ids"])

    keyed = docs.select(F.xxhash64("id", "text", F.monotonically_increasing_id()).alias("key"), "id", "text")
    parts = keyed.mapInArrow(cut, "key long, id long, n long, start long, text string").repartition(common.shuffle_width(spark), "key", "n")
    found = common.map_arrow(parts, split, "key long, id long, n long, start long, text string, head array<long>, tail array<long>")
    order = Window.partitionBy("key").orderBy("n")  # of one text
    meets = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    cuts = found.select("*", meets.alias("cut")).select(
        "*",
        F.lead("cut").over(order).alias("cut_after"),
        F.lead("start").over(order).alias("start_after"),
        F.count(F.when((F.col("n") > 0) & F.col("cut").isNull(), True)).over(Window.partitionBy("key")).alias("lost"),
    )
    # Where parts never agree, each gives its own and the document is put together again.
    begin = F.when(F.col("lost") > 0, F.col("start")).otherwise(F.coalesce("cut", "start"))
    end = F.when(F.col("lost") > 0, F.col("start_after")).otherwise(F.col("cut_after"))
    piece = F.expr("substring(text, cast(begin - start + 1 as int), cast(coalesce(end - begin, length(text)) as int))")
    pieces = cuts.withColumns({"begin": begin, "end": end}).select("key", "id", "n", (F.col("lost") > 0).alias("whole"), piece.alias("piece"))
    dealt = pieces.repartition(common.shuffle_width(spark), "key", "n")
    out = common.map_arrow(dealt, encoded, "key long, id long, n long, whole boolean, piece string, ids binary", "piece")
    return out.withColumn("piece", F.when(F.col("whole"), F.col("piece")))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", cutting: Cutting = Cutting()) -> DataFrame:
    """Ids of every text: columns id (long) and ids (array of int)."""
    return _encoded(docs, path, pattern, id_column, text_column, cutting, lambda ids: (ids,), "ids array<int>", [pa.list_(pa.int32())])


def encode_digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", cutting: Cutting = Cutting()) -> DataFrame:
    """Number of ids, and digests of the ids and of the bytes that they decode to, of every text."""
    types = [pa.int64(), pa.string(), pa.string()]
    return _encoded(docs, path, pattern, id_column, text_column, cutting, lambda ids: _digests(ids, path, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string", types)


def _encoded(docs: DataFrame, path: str, pattern: str, id_column: str, text_column: str, cutting: Cutting, result, columns: str, types: list) -> DataFrame:
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def in_task(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [result(encode_chunked(t, path, pattern, cutting.chunk, cutting.overlap)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names)

    def joined(part: pa.Table) -> pa.Table:
        part = part.sort_by("n").to_pydict()
        if part["whole"][0]:
            ids = encode_chunked("".join(part["piece"]), path, pattern, cutting.chunk, cutting.overlap)
        else:
            ids = np.concatenate([np.frombuffer(x, "<u4") for x in part["ids"]]).tolist()
        return pa.table([pa.array([x], t) for x, t in zip((part["id"][0], *result(ids)), (pa.int64(), *types), strict=True)], names)

    short = common.map_arrow(rows.where(F.length("text") <= cutting.task), in_task, f"id long, {columns}")
    pieces = cut_parts(rows.where(F.length("text") > cutting.task), path, pattern, cutting)
    long = pieces.groupBy("key").applyInArrow(joined, f"id long, {columns}")  # a group is one document
    return short.unionByName(long).withColumnRenamed("id", id_column)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    import public_tokenizers

    return encode_digests(common.spread(common.table(spark, sf_dir, "documents")), vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
