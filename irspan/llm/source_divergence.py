"""How sources of one language differ in their terms: a tournament of term vectors.

Terms are counted by (language, source), combined in the tasks first.  A language's kept terms are dealt
into segments of about :data:`SEGMENT` terms by hash, its sources into blocks of about :data:`BLOCK`, and
each (segment, block) is a seat.  The members of a block stay at their seat as rows of a matrix; all others
come by as compressed vectors, one at a time, in the order of the rounds of a round-robin tournament
(circle method), so that any two blocks meet once, at the seat of one of them, and seats host about as many
meetings each.  A meeting gives both directions.  The language's own vector comes to every seat as well, and a
heap for each resident keeps the :data:`TOP` terms by which it stands out there.  Segments are added up, and
their heaps merged, at the end.  A seat's task holds one block's segment and one guest, whatever the number
of sources; all sums are of integers.

Defined cases: null text, language and source are ''.  A group without a term, or of a language without
kept terms, has empty vectors: it has its ``pair`` rows (of value 0 where the language keeps nothing) and no
``term`` rows.  A language's only source has no ``pair`` rows.  Rows that repeat are documents of their own.
Ties are ranked by item, in UTF-8 order.  An empty table gives no rows; very long texts are read whole;
extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irspan.llm import common

#: Documents of a language that must have a term; ranks of the ``term`` part.
LEAST_DOCUMENTS, TOP = 10, 10
#: Shares are in so many parts.
PARTS = 1_000_000_000
#: Terms of a segment and sources of a block, on average.
SEGMENT, BLOCK = 1 << 16, 8
#: Terms that a counting task holds before it sends them on.
HELD_TERMS = 1 << 18

#: A-Z become lower case, letters and bytes of other scripts stay, all else parts terms.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_INT64 = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``d`` (documents with it)."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in held.items():
                k = len(n)
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "d"])
            held.clear()

        for batch in batches:
            for part in common.slices(batch, 0):
                for text, lang, source in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    terms = terms_of(text)
                    n.update(terms)
                    d.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                    yield from sent()
        yield from sent()
        common.trim()

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(PARTS (count + 2) / (total + 2 kept)), exactly."""
    whole = max(total + 2 * kept, 1)
    raised = counts + 2
    if not len(counts) or int(raised.max()) <= _INT64 // PARTS and whole <= _INT64:
        return 1 + raised * PARTS // whole
    return np.array([1 + int(c) * PARTS // whole for c in raised], np.int64)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)): at most 10^18 before the division."""
    d = p - q
    return d * d // (p + q)


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """A sparse vector, compressed: steps between places, then counts."""
    order = np.argsort(at)
    return zlib.compress(np.diff(at[order], prepend=0).astype("<u4").tobytes() + n[order].astype("<i8").tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    raw, out = zlib.decompress(data), np.zeros(size, np.int64)
    k = len(raw) // 12
    out[np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64))] = np.frombuffer(raw, "<i8", k, 4 * k)
    return out


def _hosts(a: Column, b: Column) -> Column:
    """Whether block ``a`` is the host where it meets ``b``: odd sums at the smaller, even ones at the larger."""
    return ((a + b) % 2 == 1) == (a < b)


def _round(a: Column, b: Column, blocks: Column) -> Column:
    """Round of a round-robin tournament in which two blocks meet; with an odd number of them one rests each round."""
    rounds = blocks - 1 + blocks % 2
    return F.when((a == rounds) | (b == rounds), 2 * F.least(a, b) % rounds).otherwise((a + b) % rounds)


_VECTOR = "lang string, seg int, blocks int, block int, source string, total long, kept long, size int, vector binary"


def _vectors(counts: DataFrame, groups: DataFrame, segment: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Compressed vectors of all groups and of all languages (``source`` null), by segment; and the kept terms."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where(F.col("d") >= LEAST_DOCUMENTS)
    kept = common.written(kept, "kept_terms")
    stats = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(stats, "lang", "left").na.fill(0, ["kept", "total"])
    up = lambda c, n: F.greatest(F.lit(1), F.ceil(F.col(c) / n)).cast("int")
    langs = common.written(langs.select("lang", "kept", "total", up("kept", segment).alias("segs"), up("groups", block).alias("blocks")), "langs")
    by_term = Window.partitionBy("lang", "seg").orderBy("term")
    terms = kept.join(langs.select("lang", "segs"), "lang").withColumn("seg", F.pmod(F.xxhash64("term"), "segs").cast("int"))
    terms = common.written(terms.select("lang", "seg", "term", "n", (F.row_number().over(by_term) - 1).alias("at")), "terms")
    pairs = F.collect_list(F.struct("at", "n")).alias("pairs")
    own = terms.groupBy("lang", "seg").agg(pairs, F.count("*").cast("int").alias("size"))
    found = common.written(counts.select("lang", "source", "term", "n").join(terms.drop("n"), ["lang", "term"]).groupBy("lang", "seg", "source").agg(pairs, F.sum("n").alias("n")), "vectors")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    places = langs.select("lang", "kept", "blocks", F.explode(F.sequence(F.lit(0), F.col("segs") - 1)).alias("seg")).join(own.select("lang", "seg", "size"), ["lang", "seg"], "left")
    members = groups.join(totals, ["lang", "source"], "left").join(places, "lang").join(found.drop("n"), ["lang", "seg", "source"], "left")
    members = members.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    whole = own.join(langs, "lang").withColumn("source", F.lit(None).cast("string")).withColumn("block", F.lit(-1))
    columns = ["lang", "seg", "blocks", "block", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", F.coalesce("size", F.lit(0)).alias("size"), "pairs"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pairs in b.column(8):
                inner = pairs.values
                out.append(packed(*(inner.field(i).to_numpy().astype(np.int64) for i in (0, 1))) if inner is not None else zlib.compress(b""))
            yield pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(out, pa.binary())], names=_NAMES)

    rows = members.select(*columns).unionByName(whole.select(*columns))
    return rows.mapInArrow(pack, _VECTOR), terms


_NAMES = [c.split()[0] for c in _VECTOR.split(", ")]
#: Order in which rows come to a seat: its residents, the language, then guests by round.
_RESIDENT, _LANGUAGE, _FIRST_ROUND = range(3)


def _seats(vectors: DataFrame) -> DataFrame:
    """Every vector at the seats that it comes to, in order, one seat in one task."""
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    groups = vectors.where(F.col("source").isNotNull())
    residents = groups.withColumn("seat", F.col("block")).withColumn("turn", F.lit(_RESIDENT))
    language = vectors.where(F.col("source").isNull()).withColumn("seat", F.explode(blocks)).withColumn("turn", F.lit(_LANGUAGE))
    others = F.filter(blocks, lambda o: (o != F.col("block")) & _hosts(o, F.col("block")))
    guests = groups.withColumn("seat", F.explode(others)).withColumn("turn", (_FIRST_ROUND + _round(F.col("seat"), F.col("block"), F.col("blocks"))).cast("int"))
    rows = residents.unionByName(language).unionByName(guests).select("lang", "seg", "seat", "turn", "source", "total", "kept", "size", "vector")
    return rows.repartition(common.shuffle_width(vectors.sparkSession), "lang", "seg", "seat").sortWithinPartitions("lang", "seg", "seat", "turn", "source")


class _Seat:
    """The residents of one seat, their guests' results, and their heaps."""

    def __init__(self, lang: str, seg: int, top: int):
        self.lang, self.seg, self.top, self.sources, self.rows = lang, seg, top, [], []
        self.counts: list[np.ndarray] = []
        self.p: np.ndarray | None = None

    def sit(self, source: str, counts: np.ndarray, p: np.ndarray) -> Iterator[tuple]:
        """A further resident, which meets those before it."""
        yield from self.meet(source, p)
        self.sources.append(source)
        self.rows.append(p)
        self.counts.append(counts)
        self.p = None

    def meet(self, source: str, q: np.ndarray) -> Iterator[tuple]:
        """A guest and all residents, in both directions."""
        if not self.sources:
            return
        if self.p is None:
            self.p = np.vstack(self.rows)
            self.rows = list(self.p)
        for own, value in zip(self.sources, distances(self.p, q).sum(1).tolist(), strict=True):
            yield self.lang, own, source, None, None, value
            yield self.lang, source, own, None, None, value

    def stand_out(self, q: np.ndarray) -> Iterator[tuple]:
        """For each resident the first terms by which it exceeds the language; ties in the order of terms."""
        for own, p, counts in zip(self.sources, self.rows, self.counts, strict=True):
            at = np.flatnonzero((counts > 0) & (p > q))
            value = distances(p[at], q[at])
            for v, place in heapq.nsmallest(self.top, zip((-value).tolist(), at.tolist(), strict=True)):
                yield self.lang, own, None, self.seg, place, -v
        self.counts = []


def _meetings(seats: DataFrame, top: int) -> DataFrame:
    """Values of pairs (``item`` is the other source) by segment, and each segment's first terms (``place``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = seat = None
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                lang, seg, number, turn, source, total, kept, size, data = (batch.column(i)[r].as_py() for i in range(9))
                if key != (lang, seg, number):
                    key, seat = (lang, seg, number), _Seat(lang, seg, top)
                counts = unpacked(data, size)
                p = shares(counts, total, kept)
                out.extend(seat.sit(source, counts, p) if turn == _RESIDENT else seat.stand_out(p) if turn == _LANGUAGE else seat.meet(source, p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["lang", "source", "item", "seg", "place", "value"])

    return seats.mapInArrow(run, "lang string, source string, item string, seg int, place int, value long")


def audit(docs: DataFrame, segment: int = SEGMENT, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: distances to the other sources of the language
    (``pair``) and the first ``top`` terms by which a source exceeds it (``term``)."""
    spark = docs.sparkSession
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counts = common.written(term_counts(docs), "term_counts")
    vectors, terms = _vectors(counts, groups, segment, block)
    with common.batches(spark, 16):  # a row is a whole segment of a source
        vectors = common.written(vectors, "packed_vectors")
        met = common.written(_meetings(_seats(vectors), top), "meetings")
    pairs = met.where(F.col("item").isNotNull()).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    named = met.where(F.col("item").isNull()).drop("item").join(terms.select("lang", "seg", F.col("at").alias("place"), F.col("term").alias("item")), ["lang", "seg", "place"]).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", rank).select(*columns).unionByName(named.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language, and the terms by which each stands out."""
    return audit(common.spread(common.table(spark, sf_dir, "documents").select("text", "lang", "source")))


QUERIES = {"op11_source_divergence": op11_source_divergence}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {
    "op11_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS lang_n
  FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN found AS f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sizes AS (SELECT lang, source, sum(n)::HUGEINT + 2 * count(*) AS own, sum(lang_n)::HUGEINT + 2 * count(*) AS whole FROM counts GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, n, 1 + ({PARTS}::HUGEINT * (n + 2)) // own AS p, 1 + ({PARTS}::HUGEINT * (lang_n + 2)) // whole AS q
  FROM counts JOIN sizes USING (lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, 0::HUGEINT AS f FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT a.lang, a.source, b.source, ((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, sum(f)::BIGINT AS value FROM pairs GROUP BY lang, source, item
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary")::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}""",
}
