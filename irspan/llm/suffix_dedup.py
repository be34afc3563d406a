"""Removal of repeated passages: every byte covered by a string of :data:`MATCH` bytes that also
starts earlier, in a smaller id or before it in the same text.

A position goes when its longest previous factor (the longest string from there that also starts
earlier) is that long.  Suffixes of all texts cannot be sorted in one place, so they are dealt out by
content, in such a way that equal strings of :data:`MATCH` bytes meet:

1. Each such string is represented by its anchor, the :data:`GRAM` bytes in it with the least hash
   (the leftmost of equals).  Neighbouring strings share an anchor; the bytes that the strings of one
   anchor cover are its context.  Anchors are one in about 35 positions, and only hashes are moved.
2. Contexts of an anchor that are equal have the same strings, so all but the first are repeats
   throughout.  The first of each is looked at again only if its anchor has different contexts (at
   the ends of a passage, around an edit).
3. The contexts of an anchor meet.  Their suffixes are put in suffix order with the array of longest
   common prefixes; the previous and the next smaller place in that order give each suffix its longest
   previous factor, and those of :data:`MATCH` bytes or more are repeats.  An anchor with more than
   :data:`MOST_CONTEXTS` contexts is dealt out by strings: those of a block of texts are put in
   suffix order there, and what is first in its block meets that of other blocks by its digest.

Hot passages are reduced to their first copy in each block of rows before they are moved, and all
groups are read as sorted streams, never gathered.

Defined cases: a null or empty text loses nothing and is of 0 bytes; so do texts shorter than
:data:`MATCH`; an empty table gives no rows.  Very long texts are hashed in parts that overlap.  A null
id comes after all others.  Rows with equal ids are told apart by 64 bits of a hash of their text, the
tie, and come in its order; rows with equal ids and texts are one document, and get the same result.
Extra columns, whatever their names, are not looked at.  Equality of contexts is decided by 128 bits of
hashes (anchor and context; in hot anchors also anchor and string).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

MATCH, GRAM = 100, 32
_WINDOW = MATCH - GRAM + 1
#: Bytes of text hashed at a time; longer texts are cut, with an overlap of MATCH - 1.
CHUNK = 1 << 19
#: Anchors, and strings, that a task holds to reduce before it sends them on.
HELD_ROWS, HELD_STRINGS = 200_000, 40_000
#: Contexts of an anchor that meet in one place.
MOST_CONTEXTS = 1000

_BASE = 0x9E3779B97F4A7C15
_NO_ID = (1 << 63) - 1
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from each position on (zeros behind the end)."""
    h = np.zeros(len(data) + 64, _U)
    h[: len(data)] = data
    h += _U(1)
    power, out = _BASE, []
    for step in (1, 2, 4, 8, 16, 32):
        h[:-step] = h[:-step] * _U(power) + h[step:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        if step == 16:
            out.append(h[: len(data)].copy())
    return out[0], h[: len(data)]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of MATCH bytes in texts that lie one behind the other.

    Returns for each: text number, first and last start of its strings, its own position (all from
    the beginning of ``data``), hash of the anchor (63 bits) and of the context.
    """
    h32, h64 = _rolling(data)
    grams = _mix(h32)
    key = (grams & _U(0xFFFFFFFFFF000000)) | np.arange(len(data), dtype=_U)
    least, step = key, 1
    while 2 * step <= _WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if _WINDOW > step:
        least = np.minimum(least[: len(least) - (_WINDOW - step)], least[_WINDOW - step :])
    counts = np.maximum(ends - starts - MATCH + 1, 0)
    doc = np.repeat(np.arange(len(starts)), counts)
    if not len(doc):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none
    p = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    at = (least[p] & _U(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    first, last, at, doc = p[new], p[np.concatenate((new[1:] - 1, [len(p) - 1]))], at[new], doc[new]
    length = last - first + MATCH
    context = _mix(h64[first]) * _U(3) + _mix(h64[first + (length - 64) // 2] * _U(5) + _U(1)) + _mix(h64[first + length - 64] * _U(7) + _U(2))
    context = _mix(context + (length * 128 + at - first).astype(_U) * _U(_BASE))
    return doc, first, last, at, (grams[at] >> _U(1)).view(np.int64), context.view(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts, or parts of a long one, of about CHUNK bytes: text numbers, offsets of the
    parts in their texts, the bytes, and where each part starts and ends in them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - MATCH + 1), CHUNK):
            part = t[at : at + CHUNK + MATCH - 1] if len(t) > CHUNK + MATCH - 1 else t
            if held and size + len(part) > CHUNK:
                yield _joined(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
            if part is t:
                break
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]):
    lengths = np.array([len(x) for _, _, x in held], np.int64)
    ends = np.cumsum(lengths)
    return [i for i, _, _ in held], [at for _, at, _ in held], np.frombuffer(b"".join(x for _, _, x in held), np.uint8), ends - lengths, ends


def _repeats(new: np.ndarray, id_: np.ndarray, tie: np.ndarray, place: np.ndarray, before: tuple | None = None) -> np.ndarray:
    """Rows of classes that aren't at the place of their class's first; new: where classes begin, before:
    id, tie and place of the first of a class that goes on."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    out = (id_ != id_[first]) | (tie != tie[first]) | (place != place[first])
    if before is not None:
        on = first < 0
        out[on] = (id_[on] != before[0]) | (tie[on] != before[1]) | (place[on] != before[2])
    return out


def _later(order_by: tuple[np.ndarray, ...], id_: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows repeat an earlier one: equal in ``order_by``, later by id, tie and place."""
    out = np.zeros(len(id_), bool)
    if len(id_) < 2:
        return out
    order = np.argsort(order_by[0], kind="stable")
    same = np.ones(len(order) - 1, bool)
    for c in order_by:
        same &= c[order][1:] == c[order][:-1]
    near = np.zeros(len(order), bool)
    near[1:] |= same
    near[:-1] |= same
    some = order[near]  # only rows with an equal neighbour; a class may still be apart where the first column ties
    some = some[np.lexsort((place[some], tie[some], id_[some], *(c[some] for c in reversed(order_by))))]
    if len(some):
        new = np.ones(len(some), bool)
        new[1:] = np.any([c[some][1:] != c[some][:-1] for c in order_by], axis=0)
        out[some] = _repeats(new, id_[some], tie[some], place[some])
    return out


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, context, id, tie, place.  Anchors have a key of 0 or more; a place is the anchor's
    position and how far before it its first and last strings start.  Rows with a negative key are
    ranges of repeats found within the task: the context is where one starts and ends."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def give() -> pa.RecordBatch:
        key, context, id_, tie, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        later = _later((context, key), id_, tie, place)
        i, t, begin, end, _, _ = _ranges(id_[later], tie[later], place[later], key[later])
        i, t, begin, end = _merged(i, t, begin, end)
        # Ranges go where their document's hash sends them.
        spread = (_mix(i.view(_U) + _mix(t.view(_U)) + _U(1)) >> _U(1)).view(np.int64)
        columns = zip((key[~later], context[~later], id_[~later], tie[~later], place[~later]), (-1 - spread, (begin << 32) | end, i, t, np.zeros(len(i), np.int64)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "context", "id", "tie", "place"])

    for batch in batches:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        ties = batch.column(1).to_numpy(zero_copy_only=False)
        for which, offsets, data, starts, ends in _pieces(batch.column(2).to_pylist()):
            doc, first, last, at, key, context = anchors(data, starts, ends)
            if not len(doc):
                continue
            which, offsets = np.array(which)[doc], np.array(offsets, np.int64)[doc]
            own = at - starts[doc] + offsets
            place = (own << 14) | ((at - first) << 7) | (at - last)
            held.append((key, context, ids[which], ties[which], place))
            size += len(key)
            if size >= HELD_ROWS:
                yield give()
                size = 0
    if held:
        yield give()
    common.trim()


_RANGE = "id long, tie long, begin long, end long, at long, key long"
_RANGE_NAMES = ["id", "tie", "begin", "end", "at", "key"]


def _ranges(id_: np.ndarray, tie: np.ndarray, place: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    at = place >> 14
    return [id_, tie, at - ((place >> 7) & 127), at - (place & 127) + MATCH, at, key]


def _merged(id_: np.ndarray, tie: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranges of equal length or in one pass over a text, those that touch put together."""
    if not len(id_):
        return [id_, tie, begin, end]
    order = np.lexsort((begin, tie, id_))
    id_, tie, begin, end = id_[order], tie[order], begin[order], end[order]
    new = np.flatnonzero(np.concatenate(([True], (id_[1:] != id_[:-1]) | (tie[1:] != tie[:-1]) | (begin[1:] > end[:-1]))))
    return [id_[new], tie[new], begin[new], np.maximum.reduceat(end, new)]


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key, context, id, tie, place: ranges of repeats (key -1), and those first
    contexts whose anchors have several (with their key)."""
    last_key = last_context = first = None
    waiting = None  # the first row of the current anchor while it has one context only
    for batch in batches:
        key, context, id_, tie, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        ready = key < 0
        out = [[id_[ready], tie[ready], context[ready] >> 32, context[ready] & 0xFFFFFFFF, np.zeros(int(ready.sum()), np.int64), np.full(int(ready.sum()), -1)]]
        key, context, id_, tie, place = (c[~ready] for c in (key, context, id_, tie, place))
        if len(key):
            new_key = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([context[0] != last_context], context[1:] != context[:-1]))
            again = _repeats(new, id_, tie, place, first)
            i = int(np.flatnonzero(new)[-1]) if new.any() else None
            first = (id_[i], tie[i], place[i]) if i is not None else first
            out.append(_ranges(id_[again], tie[again], place[again], np.full(int(again.sum()), -1)))
            run = np.cumsum(new_key)  # 0: goes on from the batch before
            several = np.zeros(int(run[-1]) + 1, bool)
            several[run[new & ~new_key]] = True
            if several[0] and waiting is not None:
                out.append(_ranges(*(np.array([x]) for x in waiting)))
                waiting = None
            look = new & several[run]
            out.append(_ranges(id_[look], tie[look], place[look], key[look]))
            if run[-1]:
                i = int(np.flatnonzero(new_key)[-1])
                waiting = None if several[-1] else (id_[i], tie[i], place[i], key[i])
            last_key, last_context = key[-1], context[-1]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], _RANGE_NAMES)


def suffix_array(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of suffixes that are given as zero-padded rows of bytes, equal ones by their place,
    and the length of the longest common prefix of each with the one before it (0 for the first)."""
    n, width = rows.shape
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    words = rows.view(np.uint64)
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 15):
        here, last = order[at : at + (1 << 15)], order[at - 1 : at - 1 + min(1 << 15, n - at)]
        differ = words[here] ^ words[last]
        word = (differ != 0).argmax(axis=1)
        first = differ[np.arange(len(here)), word]
        low = first & (~first + _U(1))  # the lowest set bit lies in the first byte that differs
        byte = np.where(first == 0, width, 8 * word + (np.bitwise_count(low - _U(1)) >> 3))
        lcp[at : at + len(here)] = np.minimum(byte, np.minimum(lengths[here], lengths[last]))
    return order, lcp


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """For each place the length of the longest string from there that also starts at a smaller place;
    values under ``least`` are given as 0.

    In suffix order that string is shared with the nearest entry before, or after, that has a smaller
    place (the previous and the next smaller value): its length is the least common prefix on the
    way there.  Both are found for all entries at once by jumping along the pointers found so far; an
    entry is given up as soon as its common prefix is under ``least``.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        low = np.zeros(n, np.int64)
        if step < 0:
            low[1:] = lcp[1:]
        else:
            low[:-1] = lcp[1:]
        open_ = np.flatnonzero(low >= least)
        while len(open_):
            open_ = open_[order[to[open_]] > order[open_]]
            there = to[open_]
            low[open_], to[open_] = np.minimum(low[open_], low[there]), to[there]
            open_ = open_[low[open_] >= least]
        best = np.maximum(best, np.where(low >= least, low, 0))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


_MET = "route long, key long, id long, tie long, place long, body binary"
_MET_NAMES = ["route", "key", "id", "tie", "place", "body"]


def _suffixes(bodies: list[bytes], id_: np.ndarray, tie: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The suffixes of at least MATCH bytes of contexts, in the order of their places: padded rows of
    bytes, lengths, ids, ties, places, and which context each is of.  A row that repeats (equal id,
    tie and place) is one context."""
    order = np.lexsort((place, tie, id_))
    new = np.ones(len(order), bool)
    new[1:] = (id_[order][1:] != id_[order][:-1]) | (tie[order][1:] != tie[order][:-1]) | (place[order][1:] != place[order][:-1])
    order = order[new]
    lengths = np.fromiter((len(bodies[i]) for i in order), np.int64, len(order))
    width = -(-int(lengths.max()) // 8) * 8
    data = np.frombuffer(b"".join([*(bodies[i] for i in order), bytes(width)]), np.uint8)
    counts = lengths - MATCH + 1
    which = np.repeat(np.arange(len(order)), counts)
    within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[within + np.repeat(np.cumsum(lengths) - lengths, counts)].copy()
    left = lengths[which] - within
    rows *= np.arange(width) < left[:, None]
    which = order[which]
    return rows, left, id_[which], tie[which], place[which] + (within << 14), which


def _repeated(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which suffixes start with MATCH bytes that also start at a smaller place."""
    return longest_previous_factors(*suffix_array(rows, lengths), MATCH) >= MATCH


def _digests(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first MATCH bytes of each row."""
    words = np.zeros((len(rows), 13), _U)
    words.view(np.uint8)[:, :MATCH] = rows[:, :MATCH]
    out = np.zeros(len(rows), _U)
    for j in range(13):
        out = _mix(out * _U(31) + words[:, j] + _U(_BASE + j))
    return out.view(np.int64)


def _find_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows route, key, id, tie, place (the start) and body: contexts, which meet by their key, and of
    hot anchors the strings that are the first in this block, which meet by their digest.  Repeats
    among these have the key -1."""
    cold: list[tuple] = []
    hot: list[tuple] = []
    sizes = [0, 0]

    def give_cold() -> pa.RecordBatch:
        key, id_, tie, place, body = zip(*cold, strict=True)
        cold.clear()
        sizes[0] = 0
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(key, pa.int64()), pa.array(id_, pa.int64()), pa.array(tie, pa.int64()), pa.array(place, pa.int64()), pa.array(body, pa.binary())], _MET_NAMES)

    def give_hot() -> pa.RecordBatch:
        keys, ids, ties, places, bodies = zip(*hot, strict=True)
        hot.clear()
        sizes[1] = 0
        suffixes, lengths, id_, tie, place, which = _suffixes(list(bodies), *(np.array(x, np.int64) for x in (ids, ties, places)))
        again = _repeated(suffixes, lengths)
        key = np.where(again, -1, np.array(keys, np.int64)[which])
        route = np.where(again, _mix(id_.view(_U) + _mix(tie.view(_U))).view(np.int64), _digests(suffixes))
        return pa.RecordBatch.from_arrays([pa.array(route), pa.array(key), pa.array(id_), pa.array(tie), pa.array(place), pa.nulls(len(id_), pa.binary())], _MET_NAMES)

    for batch in batches:
        for row_id, tie, text, contexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for c in contexts:
                row = (c["key"], row_id, tie, c["begin"] << 14, text[c["begin"] : c["end"]])
                (hot if c["hot"] else cold).append(row)
                sizes[bool(c["hot"])] += c["end"] - c["begin"] - MATCH + 1
                if sizes[0] >= 4 * HELD_STRINGS:
                    yield give_cold()
                if sizes[1] >= HELD_STRINGS:
                    yield give_hot()
    if cold:
        yield give_cold()
    if hot:
        yield give_hot()
    common.trim()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of route, key, id, tie, place: ranges of all strings but the first of a class."""
    last = first = None
    held: list[tuple] = []  # contexts of whole anchors, and of one that may go on
    size = 0

    def ranges(id_: np.ndarray, tie: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        p = place >> 14
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(id_, tie, p, p + MATCH)], ["id", "tie", "begin", "end"])

    def match(rows: list[tuple]) -> pa.RecordBatch:
        _, ids, ties, places, bodies = zip(*rows, strict=True)
        suffixes, lengths, id_, tie, place, _ = _suffixes(list(bodies), *(np.array(x, np.int64) for x in (ids, ties, places)))
        again = _repeated(suffixes, lengths)
        return ranges(id_[again], tie[again], place[again])

    for batch in batches:
        route, key, id_, tie, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
        whole = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        for row in zip(key[whole].tolist(), id_[whole].tolist(), tie[whole].tolist(), place[whole].tolist(), batch.column(5).filter(pa.array(whole)).to_pylist(), strict=True):
            if size >= HELD_STRINGS and row[0] != held[-1][0]:
                out = match(held)
                if out.num_rows:
                    yield out
                held, size = [], 0
            held.append(row)
            size += len(row[4]) - MATCH + 1
        alone = ~whole
        route, key, id_, tie, place = (c[alone] for c in (route, key, id_, tie, place))
        again = key < 0
        d, k, i, t, p = (c[~again] for c in (route, key, id_, tie, place))
        if len(d):
            new = np.concatenate(([(d[0], k[0]) != last], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
            again[~again] = _repeats(new, i, t, p, first)
            if new.any():
                at = int(np.flatnonzero(new)[-1])
                first = (i[at], t[at], p[at])
            last = (d[-1], k[-1])
        if again.any():
            yield ranges(id_[again], tie[again], place[again])
    if held:
        out = match(held)
        if out.num_rows:
            yield out
    common.trim()


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, tie and text in bytes; the tie tells rows with equal ids apart."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def removed_ranges(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ranges of bytes to remove: columns id, tie, begin and end, overlapping; written to the shared folder."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = _keyed(docs, id_column, text_column)
    width = common.shuffle_width(spark)
    found = rows.mapInArrow(_find_anchors, "key long, context long, id long, tie long, place long")
    found = found.repartition(width, "key").sortWithinPartitions("key", "context", "id", "tie", "place").mapInArrow(_sort_contexts, _RANGE)
    found = common.written(found, "repeats")
    common.release(spark)
    contexts = found.where("key >= 0").select("id", "tie", "begin", "end", "key")
    hot = contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_CONTEXTS).select("key", F.lit(True).alias("hot"))
    hot = common.written(hot, "hot")  # a table of its own, so that the join's skew can be split
    entry = F.struct("begin", "end", "key", F.coalesce("hot", F.lit(False)).alias("hot"))
    lists = contexts.join(hot, "key", "left").groupBy("id", "tie").agg(F.collect_list(entry).alias("contexts"))  # of one text
    met = rows.join(lists.hint("shuffle_hash"), ["id", "tie"]).select("id", "tie", "text", "contexts").mapInArrow(_find_contexts, _MET)
    met = met.repartition(width, "route").sortWithinPartitions("route", "key", "id", "tie", "place").mapInArrow(_meet, "id long, tie long, begin long, end long")
    more = common.written(met, "repeats")
    common.release(spark)
    return found.where("key < 0").select("id", "tie", "begin", "end").unionByName(more)


def _spans(ranges: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of begin-and-end numbers."""
    out: list[list[int]] = []
    for x in sorted(ranges):
        begin, end = x >> 32, x & 0xFFFFFFFF
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for begin, end in spans:
        parts.append(text[at:begin])
        at = end
    return b"".join((*parts, text[at:]))


def _with_ranges(docs: DataFrame, id_column: str, text_column: str, keep: list) -> DataFrame:
    ranges = removed_ranges(docs, id_column, text_column)
    lists = ranges.groupBy("id", "tie").agg(F.collect_list(F.shiftleft("begin", 32).bitwiseOR(F.col("end"))).alias("ranges"))  # of one text
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"), *keep)
    return rows.join(lists.hint("shuffle_hash"), ["id", "tie"], "left").drop("tie")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What is removed of each text, and the digest of what is left."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row_id, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = _spans(ranges or [])
            rows.append((row_id, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(text, spans)).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_ranges(docs, id_column, text_column, []).select("id", "text", "ranges")
    out = common.map_arrow(rows, run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id"))).withColumnRenamed("id", id_column)


def cleaned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeats taken out of the text; a character that is cut through goes whole."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.names.index("text")
        texts = [_kept(t, _spans(r or [])).decode("utf-8", "ignore") for t, r in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], [*batch.schema.names[:at], "text"])

    rest = [c for c in docs.columns if c != text_column]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(rest)]
    rows = _with_ranges(docs, id_column, text_column, kept).select(*(f"k{i}" for i in range(len(rest))), "text", "ranges")
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "text string"])
    out = common.map_arrow(rows, run, schema)
    return out.select(*(F.col("text" if c == text_column else f"k{rest.index(c)}").alias(c) for c in docs.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    return digests(common.spread(common.table(spark, sf_dir, "documents")))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
