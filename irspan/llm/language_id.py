"""Language of a text from n-gram filters with a bit for each language.

Learning counts letter n-grams (three and four letters, case folded, words padded by a space) by
language over a bounded sample of the labelled rows and keeps, for each language, those whose
relative frequency there is at least :data:`SHARE` of its highest in any language.  They go into one
bit-sliced Bloom filter: a table of language bitmasks in which an n-gram sets its languages' bits at
:data:`HASHES` places, so one look-up (the places' masks and-ed) returns every language that contains
the n-gram.  Languages have their bits in as many 64-bit words as they need.  The filter's size is
fixed, and the n-grams in it are not capped: executors put together the masks of each place, and a
fuller filter has a higher rate of false positives, which is measured for each language.  A text is
decided by its popcount for each language over all its n-grams, corrected for that rate.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text none of whose
n-grams is known gets the most frequent language and score 0; ties go to the more frequent language, of
equally frequent ones to the first by name.  Without a labelled row every text is ``und``.  Rows that
repeat get the same result, and count as often as they are met when learned from.  A very long text is
looked at whole.  An empty table gives no rows.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

#: Lengths of n-grams, places that each sets, and slots of the filter.
ORDERS = (3, 4)
HASHES = 3
SLOTS = 1 << 21
#: At most about so many labelled rows of a language are learned from, picked by a hash of id and text.
SAMPLE_ROWS = 10_000
#: How frequent an n-gram must be, against its best language, to stand for a language.
SHARE = 0.5
UNDETERMINED = "und"
#: Languages whose bits share a word.
WORD = 64

_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it isn't a letter."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each within spaces, and where each begins (and the end)."""
    joined = " " + " ".join([t or "" for t in texts]) + " "
    starts = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    return _folded()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64), starts


def _grams(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as numbers, and which are wanted: inside one word with the space on either side."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    code = points[:n].copy()
    space = points == _SPACE
    wanted = ~space[1 : n + 1]
    for i in range(1, order):
        code = code * np.uint64(0x110000 if order == 3 else 0x10001F) + points[i : n + i]
        if 1 < i < order - 1:
            wanted &= ~space[i : n + i]
    return code, wanted


def _places(code: np.ndarray, order: int, slots: int) -> list[np.ndarray]:
    h = (code + np.uint64(order)) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    """Languages (most frequent first), the filter's masks (a row for each word of languages, a column
    for each slot), and each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (its share of the corrected counts) and coverage (of the n-grams) of each text."""
        points, starts = _points(texts)
        k = len(self.languages)
        hits, totals, letters = np.zeros((k, len(texts))), np.zeros(len(texts)), np.zeros(len(texts))
        if len(texts):
            letters = np.add.reduceat((points != _SPACE).astype(np.int64), starts[:-1])
        for order in ORDERS:
            code, wanted = _grams(points, order)
            at = np.flatnonzero(wanted)
            if not len(at) or not k:
                continue
            code = code[at]
            places = _places(code, order, self.masks.shape[1])
            first = np.searchsorted(at, starts)
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
            totals += np.diff(first)
            bit = self.masks.dtype.type
            for w, word in enumerate(self.masks):
                masks = np.bitwise_and.reduce([word[p] for p in places])
                for j in range(min(WORD, k - w * WORD)):
                    hits[w * WORD + j] += sums((masks >> bit(j)) & bit(1))
        names, scores, covers = [], [], []
        if k:
            hits = np.maximum((hits - totals * self.wrong[:, None]) / (1 - self.wrong[:, None]), 0)
            best = hits.argmax(axis=0)
        for i, n in enumerate(letters.tolist()):
            if not k or texts[i] is None or not n:
                names.append(UNDETERMINED), scores.append(0.0), covers.append(0.0)
                continue
            most, total = float(hits[best[i], i]), float(hits[:, i].sum())
            names.append(self.languages[best[i]])
            scores.append(min(1.0, most / total) if total else 0.0)
            covers.append(min(1.0, most / totals[i]) if totals[i] else 0.0)
        return names, scores, covers


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows: of each language about ``sample_rows``, by a hash of id and text.

    Counts of languages cover all rows; the sample bounds only what n-grams are counted over.  What
    reaches the driver are the masks of the filter's slots.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0))
    pick = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    limit = F
    for x in languages:
        limit = limit.when(F.col("lang") == x, int(min(1.0, sample_rows / sizes[x]) * (1 << 30)))
    number = {x: i for i, x in enumerate(languages)}
    common.small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def give(key: tuple[int, int]) -> pa.RecordBatch:
            codes, counts = zip(*held.pop(key), strict=True)
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), key[0])), pa.array(np.full(len(code), key[1])), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "gram_order", "code", "n"])

        for batch in batches:
            for part in common.slices(batch, 1):
                texts, langs = part.column(1).to_pylist(), part.column(2).to_pylist()
                for x in set(langs):
                    points, _ = _points([t for t, y in zip(texts, langs, strict=True) if y == x])
                    for order in ORDERS:
                        code, wanted = _grams(points, order)
                        if wanted.any():
                            held.setdefault((number[x], order), []).append(np.unique(code[wanted], return_counts=True))
            for key in [k for k, v in held.items() if sum(len(c) for c, _ in v) > 2_000_000]:
                yield give(key)
        for key in list(held):
            yield give(key)

    grams = rows.where(pick < limit).mapInArrow(count, "lang long, gram_order long, code long, n long").groupBy("lang", "gram_order", "code").agg(F.sum("n").alias("n"))
    grams = common.written(grams, "grams")
    totals = grams.groupBy("lang", "gram_order").agg(F.sum("n").alias("total"))
    rated = grams.join(F.broadcast(totals), ["lang", "gram_order"])  # a row for each language and order
    by_gram = rated.groupBy("gram_order", "code").agg(F.collect_list(F.struct("lang", (F.col("n") / F.col("total")).alias("rate"))).alias("found"))  # a language at most once
    most = F.array_max(F.transform("found", lambda x: x["rate"]))
    kept = by_gram.withColumn("most", most).select("gram_order", "code", F.explode(F.filter("found", lambda x: x["rate"] >= SHARE * F.col("most"))).alias("x")).select("x.lang", "gram_order", "code")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, order, code = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for o in ORDERS:
                own = order == o
                for place in _places(code[own].view(np.uint64), o, SLOTS):
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(lang[own])], ["place", "lang"])

    bits = F.expr(f"shiftleft(1L, cast(lang % {WORD} as int))")
    table = kept.mapInArrow(placed, "place long, lang long").groupBy("place", F.expr(f"lang div {WORD}").alias("word")).agg(F.bit_or(bits).alias("mask")).toArrow()  # SLOTS places at most
    place, word, mask = (table.column(i).to_numpy() for i in range(3))
    words = -(-len(languages) // WORD)
    kind = np.dtype(f"u{next(b for b in (1, 2, 4, 8) if 8 * b >= min(WORD, len(languages)))}")
    masks = np.zeros((words, SLOTS), kind)
    masks[word, place] = mask.view(np.uint64).astype(kind)
    fill = np.array([np.count_nonzero(masks[x // WORD] & kind.type(1 << x % WORD)) / SLOTS for x in range(len(languages))])
    return Model(languages, masks, np.minimum(fill**HASHES, 0.5))


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and coverage; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS masks
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    k = len(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, covers = held.value.predict(batch.column(k).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(covers, pa.float64())], [*(f"k{i}" for i in range(k)), "lang_pred", "score", "coverage"])

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_column).alias("text"))
    out = common.map_arrow(rows, run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "lang_pred string, score double, coverage double"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "coverage")


#: A text of whose n-grams fewer belong to its language is in none of those learned.
LEAST_COVERAGE = 0.2


def accepted(docs: DataFrame, model: Model, text_column: str = "text", least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Rows of ``docs`` whose text is in a learned language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def accept(texts: list) -> list:
        names, _, covers = held.value.predict(texts)
        return [n != UNDETERMINED and c >= least_coverage for n, c in zip(names, covers, strict=True)]

    return common.filter_arrow(docs, accept, text_column)


#: Documents whose crc32 leaves this remainder by FOLDS are held out.
FOLDS, HELD_OUT = 5, 0


def is_held_out(id_column: str = "doc_id"):
    return F.coalesce(common.crc32_of(id_column) % FOLDS == HELD_OUT, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    model = train(docs.where(~is_held_out()))
    return predict(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
