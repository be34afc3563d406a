"""Near-duplicate documents by SimHash.

A text's bytes, with A-Z in lower case, are split at white space; its shingles of four words are
hashed (XXH64, seed 42) and a fingerprint bit is 1 if it is set in over half of the hashes.
Fingerprints that differ in at most :data:`BITS` bits are linked, and documents are grouped by the
components of the links.

Links are found in an inverted index on byte positions.  Two fingerprints within four bits agree in
at least four of their eight bytes, so they share one of the 20 triples of positions of a Turan
system (every four positions hold one of them).  A posting list is a triple with the values there;
for the pairs in a list the equal positional bytes are tallied, pairs that reach the guaranteed four
are verified by their differing bits, and a pair counts only once in a list: a list yields a spanning
forest of its links, never all pairs.  Copies are one entry.  Lists longer than :data:`BLOCK` are
dealt out as pairs of blocks, so no list is gathered in one task or cut short.

:func:`similar_documents` groups by a Jaccard similarity of 0.8 or more over five-word shingles, which
the pipeline asks for.  Fingerprints alone cannot give that (similar texts may differ in any number of
bits), so the SimHash index comes first and its links are verified by whole sets; then pairs that the
index missed are looked for in lists of rare shingles, among documents that aren't connected yet, and
verified likewise.  A list's entries are held against each other in the task that has them, by size and parities; it
gives a spanning forest of what these allow, not pairs.  The groups are those of all similar pairs.

Defined cases: a null text, or one without a word, has the fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle; a very long text is hashed by one task.
Rows that repeat get the same result.  Rows with a null id keep a fingerprint and get the component of
their fingerprint (:func:`near_duplicates`), or are not grouped (:func:`similar_documents`).  An empty
table gives no rows.  Extra columns, whatever their names, are not looked at.
Aggregates by fingerprint and by node combine before they are moved; joins on a hot fingerprint have
one row a key on their other side, so Spark can split the hot one (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from irspan.llm import common, shingle_sets
from irspan.llm.components import components

SHINGLE, BITS = 4, 4
#: Equal bytes that a link guarantees.
LEAST_EQUAL = 8 - BITS
#: Entries of a posting list that are compared in one piece, and entries that a task looks at together.
BLOCK, GATHERED_ROWS = 4096, 20_000
#: Was the length of lists whose pairs were all candidates; no list has such pairs now, and only a test sets it.
SHORT = 256


def _triples() -> list[tuple[int, int, int]]:
    """Positions in three groups, taken in a cycle: triples inside a group or two of one and one of
    the next.  Any four of the eight positions hold at least one of these 20."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        out += [(*pair, x) for pair in combinations(g, 2) for x in groups[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in out]


TRIPLES = _triples()


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of UTF-8 bytes."""
    return fingerprint_of(shingle_sets.shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id (long) and fp (the fingerprint's bits as a long); no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return common.map_arrow(rows, run, "id long, fp long")


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs share the guaranteed positional bytes and differ in few enough bits."""
    differ = a ^ b
    equal = (differ[..., None].view(np.uint8) == 0).sum(axis=-1)
    out = equal >= LEAST_EQUAL
    out[out] = np.bitwise_count(differ[out]) <= BITS
    return out


def _forest(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that is linked; left, right: which entries belong to either block.

    Breadth first: an entry is compared with those not reached yet, so a dense group costs little.
    """
    rest = np.arange(len(values))
    found: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(rest) or queue:
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        at = queue.pop()
        if not len(rest):
            break
        other = right[rest] if left[at] and not right[at] else left[rest] if right[at] and not left[at] else np.ones(len(rest), bool)
        near = other & _linked(values[at], values[rest])
        if near.any():
            hit = rest[near]
            found += [(at, int(x)) for x in hit]
            queue += hit.tolist()
            rest = rest[~near]
    return found


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of several batches together, of about so many rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(batch.num_columns)]
            held, size = [], 0
    if size:
        yield [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal lists: rows key, one, two (blocks), block, fp in that order."""
    rest: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        key, one, two, block, fp = cols
        n = len(key)
        if n < 2:
            return None
        edge = np.flatnonzero((key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [n])))
        values = fp.view(np.uint64)
        a_out, b_out = [], []
        # Short lists: every distance between entries at once.
        short = np.repeat((sizes > 1) & (sizes <= 8), sizes)
        run = np.repeat(np.arange(len(sizes)), sizes)
        for step in range(1, 8):
            at = np.flatnonzero(short[:-step] & (run[:-step] == run[step:])) if n > step else np.empty(0, np.int64)
            if not len(at):
                break
            at = at[_linked(values[at], values[at + step])]
            a_out.append(fp[at]), b_out.append(fp[at + step])
        for i in np.flatnonzero(sizes > 8):
            s = slice(starts[i], starts[i] + sizes[i])
            pairs = _forest(values[s], block[s] == one[s], block[s] == two[s])
            if pairs:
                x = np.array(pairs)
                a_out.append(fp[s][x[:, 0]]), b_out.append(fp[s][x[:, 1]])
        if not a_out:
            return None
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    for cols in _gathered(batches, GATHERED_ROWS):
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0  # the last run may go on
        out = links([c[:cut] for c in cols])
        if out is not None:
            yield out
        rest = [c[cut:] for c in cols]
    if rest is not None:
        out = links(rest)
        if out is not None:
            yield out


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column fp) that connect all linked ones."""
    spark = distinct.sparkSession
    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(255)
    keys = [F.lit(i).cast("long") * (1 << 24) + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c) for i, (a, b, c) in enumerate(TRIPLES)]
    posted = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    # A list of n entries has ceil(n / block) blocks; an entry goes to the pairs that hold its block.
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    rows = posted.join(sizes, "key", "left").select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.select("key", "fp", "block", other.alias("other")).select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "fp")
    ordered = dealt.repartition(common.shuffle_width(spark), "key", "one", "two").sortWithinPartitions("key", "one", "two", "fp")
    return ordered.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, fp (long) and component_id (the least id reachable by links) of every row."""
    prints = common.checkpointed(fingerprints(docs, id_column, text_column))
    firsts = common.checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first")))
    pairs = links(firsts.select("fp"))
    # Fingerprints to their least ids: edges between documents that stand for their copies.
    named = pairs.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    found = components(named.where("u is not null and v is not null").select("u", "v"))
    moved = firsts.join(found, firsts["first"] == found["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return prints.join(moved, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def _simhash_links(sketches: DataFrame, firsts: DataFrame, rows: DataFrame) -> common.Table:
    """Similar pairs of sets (a, b) among those whose fingerprints the index links, or that share one."""
    prints = common.Table(sketches.select("fp", "node").distinct().groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = links(prints.rows.select("fp"))
    one = prints.rows.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    two = prints.rows.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    apart = near.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike = sketches.select("fp", "node").distinct().join(prints.rows, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = shingle_sets.verified(apart.unionByName(alike), firsts, rows)
    prints.drop()
    return found


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id, tie (hash of the text) and component (a number) of every row with an id: the groups
    of a Jaccard similarity of 0.8 or more over five-word shingles."""
    rows = shingle_sets.keyed(docs, id_column, text_column)
    spark = rows.sparkSession
    sketches = shingle_sets.sketches(rows, fingerprint_of).rows
    firsts = sketches.groupBy("node").agg(F.min(F.struct("id", "tie")).alias("f")).select("node", "f.id", "f.tie")
    edges = lambda t: t.select(F.col("a").alias("u"), F.col("b").alias("v"))

    # 1. What the index of fingerprints finds.
    near = _simhash_links(sketches, firsts, rows).rows
    groups = components(edges(near))

    # 2. Lists of rare shingles, for pairs that aren't connected yet.
    sets = sketches.dropDuplicates(["node"])
    posted = sets.select("node", F.explode("keys").alias("key"))
    several = posted.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "node")  # HOT entries at most
    hot = sets.select("node", F.explode("hot_keys").alias("key"))
    counted = hot.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = common.Table(several.unionByName(hot.join(counted, "key").select("key", "node")), "lists")
    common.release(spark)
    known = sketches.select("node", F.struct(*shingle_sets.ENTRY).alias("e")).join(lists.rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    known = common.Table(known.join(groups, "node", "left").select("node", "e", F.coalesce("component", "node").alias("c")), "known")
    # A list all of whose entries are connected has nothing to find, nor have more lists of the same entries than one.
    some = shingle_sets.different(lists.rows.join(known.rows.select("node", "c"), "node"))
    entries = common.Table(lists.rows.join(some, "key").join(known.rows, "node").select("key", "node", "e", "c"), "entries")
    lists.drop()
    known.drop()
    common.release(spark)

    # Entries that may be linked to another one get wide parities, and meet again in their lists' tasks: pairs that these
    # refuse, whose number grows with the square of a group, are never rows.
    meetings = common.Table(shingle_sets.meeting(entries.rows, BLOCK), "meetings")
    left = common.Table(entries.rows.drop("c").join(meetings.rows, ["key", "node"], "left_semi"), "left")
    entries.drop()
    meetings.drop()
    wide = shingle_sets.values(left.rows.select("node").distinct(), shingle_sets._wide, firsts, rows, "wide")
    common.release(spark)

    # 3. A forest takes what is allowed for links.  If sets refute one, what it stood for is looked at pair by pair.
    # Wide parities are as long as a set, so only entries of lists that still differ get them, on the way to their task.
    for forest in (True, False):
        named = common.Table(left.rows.join(groups, "node", "left").select("key", "node", "e", F.coalesce("component", "node").alias("c")), "named")
        open_ = named.rows.join(shingle_sets.different(named.rows), "key", "left_semi").join(wide.rows.withColumnRenamed("value", "wide"), "node")
        pairs = common.Table(shingle_sets.crossed(open_, BLOCK, forest).distinct(), "pairs")
        named.drop()
        common.release(spark)
        found = shingle_sets.verified(pairs.rows, firsts, rows, narrow=True).rows
        n, links_ = pairs.rows.count(), found.count()
        pairs.drop()
        if links_:
            near = near.unionByName(found)
            groups = components(edges(near))
        if n == links_:
            break
    wide.drop()
    left.drop()
    common.release(spark)
    return sketches.select("id", "tie", "node").join(groups, "node", "left").select("id", "tie", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each group of :func:`similar_documents`: that with the least id, of equal
    ids that with the least hash of its text, of equal rows one.  Rows without an id stay."""
    found = similar_documents(docs, id_column, text_column)
    stay = found.groupBy("component", "id", "tie").agg(F.count("*").alias("n")).groupBy("component").agg(F.min(F.struct("id", "tie", "n")).alias("f"))
    id_, tie = common.fresh(docs, "id", "tie")
    stay = common.written(stay.select(F.col("f.id").alias(id_), F.col("f.tie").alias(tie), F.col("f.n").alias("n")), "stay")
    key = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    kept = docs.select("*", F.col(id_column).cast("long").alias(id_), key.alias(tie)).join(stay.select(id_, tie), [id_, tie], "left_semi")
    if stay.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_, tie])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_column).isNull()))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = near_duplicates(common.spread(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
