"""Pairs of long lists, counts of shingles and what is left behind, against brute force."""

import os
import random
import subprocess
import sys
import time

import numpy as np
import pytest

from irspan.llm import shingle_sets


def entry(node, size, bits):
    return (node, size, *bits)


@pytest.mark.parametrize("block", [4096, 5])
def test_pairs_of_long_lists(spark, block):
    r = random.Random(block)
    rows, flip = [], lambda bits, k: [b ^ (1 << r.randrange(63)) if i < k else b for i, b in enumerate(bits)]
    for key in range(3):
        base = [r.getrandbits(63) for _ in range(4)]
        for i in range(40):
            bits = flip(base, r.randrange(5)) if r.random() < 0.7 else [r.getrandbits(63) for _ in range(4)]
            c = r.choice([1, 1, 2, 3, 100 + i])
            rows.append((key, entry(key * 1000 + i, r.choice([8, 9, 10, 18, 19, 40]), bits), c, c == 1))
    rows.append((7, entry(7000, 9, [0] * 4), 5, True))  # alone in its list
    want = set()
    for k, e, c, main in rows:
        for k2, e2, c2, main2 in rows:
            differ = sum((x ^ y).bit_count() for x, y in zip(e[2:], e2[2:], strict=True))
            if k == k2 and e[0] < e2[0] and c != c2 and not (main and main2) and 5 * min(e[1], e2[1]) >= 4 * max(e[1], e2[1]) and 9 * differ <= e[1] + e2[1]:
                want.add((e[0], e2[0]))
    schema = "key long, e struct<node long, size long, b0 long, b1 long, b2 long, b3 long>, c long, main boolean"
    frame = spark.createDataFrame(rows, schema)
    found = [(x.a, x.b) for x in shingle_sets.crossed(frame, block).collect()]
    assert want and set(found) == want and len(found) == len(want)
    assert shingle_sets.crossed(frame.limit(0), block).count() == 0


def _entries(sets, key=1):
    """Entries of one list, each a component of its own, with wide parities."""
    out = []
    for node, found in sets.items():
        odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
        bits = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
        out.append((key, entry(node, len(found), bits), node, shingle_sets._wide(found)))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_a_group_that_is_alike_gives_no_square_of_pairs(spark, block):
    """Sets that parities of 256 classes can't tell apart, of which a third is linked: fewer pairs than entries, which
    connect what is linked; without the forest just the pairs that wide parities allow."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 700, dtype=np.uint64)
    mixed = lambda k: np.unique(np.concatenate([base[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)]))
    sets = {i: mixed(15 if i < 20 else 100) for i in range(60)}  # similarity over 0.9, and of 0.75
    linked = {(i, j) for i in sets for j in sets if i < j and shingle_sets.similar(sets[i], sets[j])}
    assert {i for p in linked for i in p} == set(range(20))
    schema = "key long, e struct<node long, size long, b0 long, b1 long, b2 long, b3 long>, c long, wide binary"
    frame = spark.createDataFrame(_entries(sets), schema)
    assert shingle_sets.crossed(frame.drop("wide"), block).count() > 1000  # before, all were rows
    assert {x.node for x in shingle_sets.meeting(frame, block).collect()} == set(sets)
    allowed = {(x.a, x.b) for x in shingle_sets.crossed(frame, block).collect()}
    assert linked <= allowed and len(allowed) < 300
    forest = {(x.a, x.b) for x in shingle_sets.crossed(frame, block, forest=True).collect()}
    assert forest <= allowed and (block < 60 or len(forest) < len(sets))
    group = {i: i for i in sets}
    for a, b in forest:
        group = {k: group[a] if g == group[b] else g for k, g in group.items()}
    assert len({group[i] for i in range(20)}) == 1


def test_wide_parities_refuse_no_link():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 900, 1030, 5000):  # on either side of a number of classes
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        for k in (0, n // 10, n // 9, n // 3):
            for b in (a[k:], np.unique(np.concatenate([a[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)]))):
                possible = shingle_sets._wide_possible(shingle_sets._wide(a), shingle_sets._wide(b))
                assert possible or not shingle_sets.similar(a, b)
                assert possible == shingle_sets._wide_possible(shingle_sets._wide(b), shingle_sets._wide(a))


def test_every_document_is_counted(spark):
    texts = ["a b c d e f", "A b  c d e", None, "", "x", "a b c d e " * 50]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = shingle_sets.class_counts(shingle_sets.keyed(frame, "doc_id", "text"))
    want = np.zeros(shingle_sets.SLOTS, np.int64)
    for t in texts:
        for h in shingle_sets.shingles((t or "").encode()).tolist():
            want[h % shingle_sets.SLOTS] += 1
    assert (counts == want).all() and counts.max() == 3
    assert not shingle_sets.class_counts(shingle_sets.keyed(frame.limit(0), "doc_id", "text")).any()


def test_nothing_is_left_after_stop(tmp_path):
    code = """
from pyspark.sql import SparkSession
import sys
spark = SparkSession.builder.master("local[2]").config(map={"spark.checkpoint.dir": sys.argv[1], "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}).getOrCreate()
from irspan.llm import simhash_dedup
docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(9)], "doc_id long, text string")
assert simhash_dedup.near_duplicates(docs).count() == 9 and simhash_dedup.one_of_each(docs).count() == 3
spark.stop()
"""
    shared = tmp_path / "shared"
    shared.mkdir()
    subprocess.run([sys.executable, "-c", code, str(shared)], check=True, timeout=600, env=os.environ)
    until = time.time() + 30  # the JVM ends a little later
    while list(shared.iterdir()) and time.time() < until:
        time.sleep(0.5)
    assert list(shared.iterdir()) == []


def test_lists_of_the_same_nodes_are_one(spark):
    """Of lists with the same nodes one stays; a list of one component goes, one that differs in a node stays."""
    lists = {5: [1, 2, 3], 6: [3, 2, 1], 4: [1, 2, 3], 7: [1, 2, 4], 8: [1, 4, 3], 9: [1, 2], 10: [6, 7], 11: [6, 7, 8], 12: [7, 6, 8]}
    rows = [(key, node, 6 if node in (6, 7) else node) for key, nodes in lists.items() for node in nodes]
    found = [x.key for x in shingle_sets.different(spark.createDataFrame(rows, "key long, node long, c long")).collect()]
    assert sorted(found) == [4, 7, 8, 9, 11]


def test_long_texts_of_a_shared_passage_move_no_square_of_their_length(spark, monkeypatch):
    """Texts with a similarity under 0.8 that share over a hundred keys: parities, which are as long as a set, went along with
    every entry of every list."""
    from irspan.llm import simhash_dedup

    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    shared = words(2550)
    texts = [" ".join(shared + words(450)) for _ in range(6)]
    texts.append(texts[2].rsplit(" ", 200)[0])  # alike: 0.93
    moved, crossed = [], shingle_sets.crossed

    def watched(apart, *more):
        moved.append(sum(len(x.wide) for x in apart.select("wide").collect()))
        return crossed(apart, *more)

    monkeypatch.setattr(shingle_sets, "crossed", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash_dedup.one_of_each(docs).collect()) == [0, 1, 2, 3, 4, 5]
    assert 0 < sum(moved) < sum(map(len, texts))
