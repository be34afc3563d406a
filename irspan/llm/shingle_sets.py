"""Documents as sets of word shingles, and the exact test of their Jaccard similarity.

The part of near-duplicate search (:mod:`simhash_dedup`) that decides: a set is posted under a prefix of
its shingles, so that any two sets that are similar enough share a list, and pairs of sets are verified
whole.  Sets, and texts, are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irspan.llm import common

SHINGLE, SEED = 5, 42
#: The least similarity of a link, as a fraction.
PART, WHOLE = 4, 5
#: Classes of shingles whose documents are counted together (a power of two), to put rare shingles first.
SLOTS = 1 << 19
#: A list may have as many entries as its shingle's class has; with more it is hot.
HOT = 1 << 20
#: Wanted documents up to which a join with the texts broadcasts them.
BROADCAST_ROWS = 200_000

_PARITIES = [f"b{i}" for i in range(4)]
#: What pairs are held against before their sets are: an entry of a list.
ENTRY = ["node", "size", *_PARITIES]


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's shingles, in the text's order: A-Z in lower case, split at ASCII white space; a
    text with fewer words is one shingle, one without a word has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are linked; empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a set is posted under: the first of ``found`` by the documents of their class
    (``counts``), then by hash.

    In any fixed order of all shingles two linked sets share one of their first n - ceil(0.8 n) + 1.
    The counts decide how long lists are, not what they find.
    """
    order = np.lexsort((found, counts[found & np.uint64(SLOTS - 1)]))
    return found[order[: len(found) - -(-PART * len(found) // WHOLE) + 1]]


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, tie (a hash of the text) and text of the rows with an id."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def class_counts(rows: DataFrame) -> np.ndarray:
    """Of each class of shingles, how many documents of ``rows`` have one, counted once a shingle.

    All documents are counted.  A task sends on a number a class, and so many reach the driver, whatever
    the size of the input.  A class counts at least as many documents as each of its shingles is in.
    """

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in common.slices(batch, 0):
                found = np.concatenate([shingles(t) for t in part.column(0).to_pylist()])
                counts += np.bincount((found & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["slot", "n"])
        common.trim()

    common.small_batches(rows.sparkSession)
    counted = rows.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return out


def sketches(rows: DataFrame, fingerprint: Callable[[np.ndarray], int]) -> common.Table:
    """Of every row: id, tie, node (hash of its set), the set's size and the parities of its shingles in
    256 classes, the fingerprint of its shingles (fp), and the keys that it is posted under, those of
    hot classes apart."""
    shared = rows.sparkSession.sparkContext.broadcast(class_counts(rows))  # SLOTS numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = [shingle_hashes(t) for t in batch.column(2).to_pylist()]
        prints = np.array([fingerprint(h) for h in whole], np.uint64).view(np.int64)
        found = [np.unique(h) for h in whole]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
        sizes = np.array([len(s) for s in found], np.int64)
        odd = np.array([np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1 for s in found], np.uint8)
        parities = np.packbits(odd, axis=1).view(np.int64)
        prefixes = [_prefix(s, shared.value) for s in found]
        many = [shared.value[s & np.uint64(SLOTS - 1)] > HOT for s in prefixes]
        keys = [s[~hot].view(np.int64) for s, hot in zip(prefixes, many, strict=True)]
        hot_keys = [s[hot].view(np.int64) for s, hot in zip(prefixes, many, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array(nodes), pa.array(sizes), *(pa.array(np.ascontiguousarray(parities[:, i])) for i in range(4)), pa.array(prints), pa.array(keys, pa.list_(pa.int64())), pa.array(hot_keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "tie", *ENTRY, "fp", "keys", "hot_keys"])

    schema = ", ".join(["id long, tie long", *(f"{c} long" for c in ENTRY), "fp long, keys array<long>, hot_keys array<long>"])
    return common.Table(common.map_arrow(rows, run, schema), "sketches")


def different(entries: DataFrame) -> DataFrame:
    """Keys of the lists (columns key, node and ``c``: its component) that have something to find: not those of one
    component alone, and of those with the same nodes the one with the least key.

    Texts that share a passage share the lists of its shingles, which hold the same nodes: so a text is in as many lists
    as there are different ones, not in one for each shingle of its prefix.  Lists are told apart by their numbers of nodes, the
    least and the greatest of these and 64 bits of hash of all.
    """
    lists = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("mix"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return lists.where("lo <> hi").groupBy("n", "first", "last", "mix").agg(F.min("key").alias("key")).select("key")


def _dealt(apart: DataFrame, block: int) -> DataFrame:
    """Entries of lists (columns key, ``e``, ``c`` and others) as key, one, two, size, block, node, c, main, parities and
    wide: a list of n entries is dealt out as pairs of its ceil(n / block) blocks, so no task holds more than two blocks
    of it; those of a pair are together, in the order of their sizes."""
    sizes = apart.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    rows = apart.join(F.broadcast(sizes), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # a row for ``block`` entries at most
    rows = rows.withColumn("block", F.pmod(F.xxhash64("e.node"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    main = F.col("main") if "main" in apart.columns else F.lit(False).alias("main")
    wide = F.col("wide") if "wide" in apart.columns else F.lit(None).cast("binary").alias("wide")
    dealt = dealt.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), F.col("e.size").alias("size"), "block", F.col("e.node").alias("node"), "c", main, *(F.col(f"e.{x}").alias(x) for x in _PARITIES), wide)
    return dealt.repartition(common.shuffle_width(apart.sparkSession), "key", "one", "two").sortWithinPartitions("key", "one", "two", "size", "node")


def _by_run(compare: Callable[[list[np.ndarray]], pa.RecordBatch | None]) -> Callable:
    """``compare`` on the columns of each pair of blocks that :func:`_dealt` made."""

    def run(batches):
        held: list[list[np.ndarray]] = []  # parts of the run that may go on
        for batch in batches:
            cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cols[0])], strict=True):
                part = [x[start:end] for x in cols]
                if held and any(held[-1][k][0] != part[k][0] for k in range(3)):
                    out = compare([np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
                    if out is not None:
                        yield out
                held.append(part)
        if held:
            out = compare([np.concatenate(x) for x in zip(*held, strict=True)])
            if out is not None:
                yield out

    return run


def _meetings(run: list[np.ndarray]):
    """Of a pair of blocks: each entry's number with those of later ones, in different components, that sizes and parities
    allow: a shingle that one set alone has turns one parity, and linked sets of n and m have at most (n + m) / 9 such.
    ``c``, a column of the run, is read anew for each entry."""
    one, two, size, place, node, c, main = run[1:8]
    bits = np.stack([x.view(np.uint64) for x in run[8:12]], axis=1)
    apart_blocks = one[0] != two[0]
    ends = np.searchsorted(size, size * WHOLE // PART, side="right")
    for i in range(len(node) - 1):
        later = slice(i + 1, ends[i])
        at = (c[later] != c[i]) & ~(main[later] & main[i])
        if apart_blocks:
            at &= place[later] != place[i]
        at = np.flatnonzero(at) + i + 1
        differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        at = at[(PART + WHOLE) * differ <= (WHOLE - PART) * (size[at] + size[i])]
        if len(at):
            yield i, at


def crossed(apart: DataFrame, block: int, forest: bool = False) -> DataFrame:
    """Pairs ``a`` < ``b`` of nodes that sizes and parities allow, among the entries of a list (columns key,
    ``e``, ``c``: its component, ``main``: whether that is the list's largest) that are in different components; entries
    meet in the order of their sizes, each only those up to 5/4 of its own.

    With a column ``wide`` (:func:`_wide` of the sets) pairs are held against it in the task, so what it refuses is never
    a row.  A ``forest`` takes a pair for a link as soon as it is allowed: the pairs that it gives connect all that are
    allowed, and are fewer than the entries.
    """

    def pairs(run: list[np.ndarray]) -> pa.RecordBatch | None:
        run[6] = c = run[6].copy()
        node, wide = run[5], run[12]
        a_out, b_out = [], []
        for i, at in _meetings(run):
            if wide[i] is not None:
                kept = []
                for j in at.tolist():
                    if forest and c[j] == c[i]:
                        continue
                    if _wide_possible(wide[i], wide[j]):
                        kept.append(j)
                        if forest:
                            c[c == c[j]] = c[i]
                at = np.array(kept, np.int64)
            a_out.append(np.minimum(node[at], node[i]))
            b_out.append(np.maximum(node[at], node[i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"]) if a_out else None

    return _dealt(apart, block).mapInArrow(_by_run(pairs), "a long, b long")


def meeting(apart: DataFrame, block: int) -> DataFrame:
    """key and node of the entries that :func:`crossed` pairs, without their pairs."""

    def met(run: list[np.ndarray]) -> pa.RecordBatch | None:
        there = np.zeros(len(run[5]), bool)
        for i, at in _meetings(run):
            there[i] = there[at] = True
        return pa.RecordBatch.from_arrays([pa.array(run[0][there]), pa.array(run[5][there])], ["key", "node"]) if there.any() else None

    return _dealt(apart, block).mapInArrow(_by_run(met), "key long, node long").distinct()


def _wide(found: np.ndarray) -> bytes:
    """A set's size and the parities of its shingles in 4096 classes, or in four times its shingles and more, by powers of
    two: so texts of any length can be told apart."""
    classes = max(4096, 1 << (4 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return len(found).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _wide_possible(x: bytes, y: bytes) -> bool:
    """Whether sizes and wide parities of two sets allow a link; the one of more classes is folded to the other's."""
    one, two, n = int.from_bytes(x[8:], "little"), int.from_bytes(y[8:], "little"), 8 * (min(len(x), len(y)) - 8)
    while one >> n or two >> n:
        mask = (1 << n) - 1
        one, two = one & mask ^ one >> n, two & mask ^ two >> n
    return (PART + WHOLE) * (one ^ two).bit_count() <= (WHOLE - PART) * (int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little"))


def values(of: DataFrame, value: Callable[[np.ndarray], bytes], firsts: DataFrame, rows: DataFrame, name: str) -> common.Table:
    """node and value of the distinct nodes ``of`` (node); ``firsts``: node, id and tie of one row of each."""
    needed = common.Table(of.join(firsts, "node"), "needed")
    few = needed.rows.count() <= BROADCAST_ROWS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([value(shingles(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["node", "value"])

    texts = rows.join(F.broadcast(needed.rows) if few else needed.rows, ["id", "tie"]).select("node", "text")
    out = common.Table(common.map_arrow(texts, run, "node long, value binary"), name)
    needed.drop()
    return out


def verified(candidates: DataFrame, firsts: DataFrame, rows: DataFrame, narrow: bool = False) -> common.Table:
    """The links among pairs ``a``, ``b`` of nodes; ``firsts``: node, id and tie of one row of each.

    Pairs are held against wide parities first, so that whole sets move only for the few that are left, unless they are
    ``narrow`` already.
    """
    spark = rows.sparkSession
    pairs = common.Table(candidates.distinct(), "candidates")
    if not pairs.rows.limit(1).count():
        return pairs

    def met(of: common.Table, held: common.Table, kept, name: str) -> common.Table:
        """Pairs whose two values ``kept`` wants; what they came from goes."""

        def compared(batches):
            for batch in batches:
                yield batch.select([0, 1]).filter(pa.array([kept(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_()))

        one = held.rows.select(F.col("node").alias("a"), F.col("value").alias("x"))
        two = held.rows.select(F.col("node").alias("b"), F.col("value").alias("y"))
        with common.batches(spark, 200):  # two sets a row
            out = common.Table(of.rows.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), name)
        of.drop()
        held.drop()
        common.release(spark)
        return out

    def nodes(of: common.Table) -> DataFrame:
        return of.rows.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    left = pairs if narrow else met(pairs, values(nodes(pairs), _wide, firsts, rows, "wide"), _wide_possible, "left")
    return met(left, values(nodes(left), lambda s: s.tobytes(), firsts, rows, "sets"), lambda x, y: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), "links")
