"""Source divergence, line dedup and embedding whitening against brute force on small, odd tables."""

import glob
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from irspan.llm import embedding_whitening as whitening
from irspan.llm import line_dedup, source_divergence

SMALL = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# ---- the registered queries against SQL


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_line_dedup"])
def test_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet{'/*.parquet' if os.path.isdir(f'{SMALL}/documents.parquet') else ''}'")
    df = entry.queries()[name](spark, SMALL)
    found = db.execute(entry.oracle_sql()[name])
    order = [df.columns.index(d[0]) for d in found.description]
    assert sorted(repr([r[i] for i in order]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


# ---- op 11


def slow_audit(rows, top=10):
    n, docs, langs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        n[lang, source].update(terms)
        langs[lang].update(terms)
        docs[lang].update(set(terms))
    p, out = {}, set()
    kept = {lang: sorted((t for t, d in docs[lang].items() if d >= 10), key=str.encode) for lang, _ in groups}

    def share(counts, lang):
        whole = sum(counts[t] for t in kept[lang]) + 2 * len(kept[lang])
        return [1 + 10**9 * (counts[t] + 2) // whole for t in kept[lang]]

    for lang, source in groups:
        p[lang, source] = share(n[lang, source], lang)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for lang, source in groups:
        pairs = [(-sum(map(f, p[lang, source], p[other])), other[1].encode()) for other in groups if other[0] == lang and other[1] != source]
        q = share(langs[lang], lang)
        terms = [(-f(a, b), t.encode()) for t, a, b in zip(kept[lang], p[lang, source], q) if n[lang, source][t] and a > b]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)}
    return out


def audit_rows():
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("Wald", "été", "lamp", "über", "x", "ñu") for b in "abcdefgh"]
    rows = [(" 7,".join(r.choice(words[: 8 + i % 40]) for _ in range(r.randrange(60))), ["en", "de", None, ""][min(i % 7, 3)], f"s{i % 23}" if i % 5 else None) for i in range(400)]
    rows += [(None, "en", "s1"), ("", "xx", "only"), ("rare words here", "yy", "a"), (None, "yy", "b"), ("lampa " * 30000, "en", "long")] + rows[:9]
    return rows


@pytest.mark.parametrize("segment, block", [(1 << 16, 8), (7, 2), (5, 1), (11, 3)])
def test_audit(spark, segment, block):
    rows = audit_rows()
    df = spark.createDataFrame([(*x, 3, "k", 1) for x in rows], "text string, lang string, source string, value long, term string, rank int").repartition(5)
    found = source_divergence.audit(df, segment, block).collect()
    want = slow_audit(rows)
    assert {tuple(x) for x in found} == want and len(found) == len(want)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert source_divergence.audit(df).collect() == []


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 10])
def test_every_pair_of_blocks_meets_once(spark, blocks):
    """Each pair has one host and one round, and nobody meets two others in a round."""
    a, b, n = F.col("a"), F.col("b"), F.lit(blocks)
    pairs = spark.range(blocks).select(F.col("id").alias("a")).crossJoin(spark.range(blocks).select(F.col("id").alias("b"))).where("a <> b")
    rows = pairs.select("a", "b", source_divergence._hosts(a, b).alias("host"), source_divergence._round(a, b, n).alias("round")).collect()
    assert Counter(frozenset((r.a, r.b)) for r in rows if r.host) == Counter({frozenset((i, j)): 1 for i in range(blocks) for j in range(i)})
    met = [(x, r.round) for r in rows if r.host for x in (r.a, r.b)]
    assert len(met) == len(set(met)) and {t for _, t in met} <= set(range(blocks - 1 + blocks % 2))
    hosted = Counter(r.a for r in rows if r.host)
    assert blocks < 3 or max(hosted.values()) - min(hosted[i] for i in range(blocks)) <= 2


def test_shares_beyond_64_bits():
    counts = np.array([0, 5, 10**13], np.int64)
    assert source_divergence.shares(counts, 10**14, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (10**14 + 6) for c in counts]


# ---- op 12


def slow_lines(rows, least=40, documents=5):
    key = lambda line: lower(line.strip(BLANKS))
    holders = defaultdict(set)
    order = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [len(h := holders.get(key(x), ())) < documents or max(h, key=order) == i for x in lines]
        out.append((i, len(lines), len(lines) - sum(keep), hashlib.sha256("\n".join(x for x, k in zip(lines, keep) if k).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(n=300):
    r = random.Random(8)
    shared = [("Line %d of a notice, " % i + "Ünïcode " * 5)[: r.randrange(36, 70)] for i in range(30)]
    rows = []
    for i in range(n):
        lines = ["a licence line that every document of this table has, in full"] * (i % 3)
        lines += [r.choice([x, "  " + x.upper().replace("Ü", "ü").replace("Ï", "ï") + "\t", f"{x} {i}"]) for x in r.sample(shared, r.randrange(5))] + [f"own {i}", ""]
        r.shuffle(lines)
        rows.append((i * 7 % 301 - 50, "\n".join(lines)))
    return rows + [(None, rows[4][1]), (None, rows[5][1]), (None, None), (900, None), (901, ""), rows[7], (rows[8][0], rows[9][1]), (902, "\n".join(rows[2][1].split("\n") * 3000))]


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_lines(spark, partitions):
    """Whatever the ranges, and so whichever hashes they cut through."""
    rows = line_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], "doc_id long, text string, pos int, keep string, bits int").repartition(3)
        found = line_dedup.cleaned(df, line_dedup.keep_bitmaps(df), count="gone").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = {(i, t or ""): n for (i, t), (_, n, _, _) in zip(sorted(rows, key=repr), slow_lines(rows))}
    assert len(found) == len(rows) == len(lines) + 1
    assert found[0].asDict().keys() == {"doc_id", "text", "pos", "keep", "bits", "gone"}
    want = Counter((i, d, h) for i, _, d, h in slow_lines(rows))
    assert Counter((r.doc_id, r.gone, hashlib.sha256(r.text.encode()).hexdigest()) for r in found) == want


def test_lines_of_a_stream_cut_anywhere():
    """The stream decides alike however its records are cut into batches and ranges."""
    r = random.Random(2)
    records = sorted({(r.randrange(6), 0, 0, -r.randrange(12), 0, 9, i) for i in range(400)})
    rows = np.array([(a, b, c, -d, e, f, g) for a, b, c, d, e, f, g in records], np.int64)
    docs = defaultdict(set)
    for x in rows:
        docs[x[0]].add(x[3])
    want = {tuple(x) for x in rows.tolist() if len(docs[x[0]]) >= 5 and x[3] != max(docs[x[0]])}
    for _ in range(60):
        cuts = sorted(r.sample(range(1, len(rows)), r.randrange(8)))
        drop, late, edges = [], [], defaultdict(list)
        for part in np.split(rows, cuts):
            stream = line_dedup._Stream(5)
            for batch in np.array_split(part, r.randrange(1, 6)):
                if len(batch):
                    stream.add(batch)
            stream.end()
            for b in stream.taken():
                for x in np.column_stack([c.to_numpy() for c in b.columns]).tolist():
                    [drop, late, edges[x[0]]][x[7]].append(x)
        for x in late:
            seen = edges[x[0]]
            if sum(e[8] for e in seen) + len({e[3] for e in seen}) >= 5 and x[3] != max(e[3] for e in seen):
                drop.append(x)
        assert len(drop) == len(want) and {tuple(x[:7]) for x in drop} == want


def test_lines_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.cleaned(df, line_dedup.keep_bitmaps(df)).collect() == []


def test_bitmaps():
    gone = np.array([0, 3, 9], np.int64)
    assert np.flatnonzero(~line_dedup.unpack_bits(10, line_dedup.pack_bits(10, gone))).tolist() == gone.tolist()
    assert len(line_dedup.pack_bits(80_000, np.arange(80_000))) < 100


# ---- op 13


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double").repartition(3)


def slow_whitening(rows, k=16):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:k]
    return kept, n, sums, v, e[order], w[:, order]


def test_whitening(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(180, 20)) @ np.diag(np.linspace(0.2, 9, 20))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(500, None), (501, [None] * 20), (502, [float("nan")] * 20), (503, [1.0] * 19 + [float("-inf")]), (504, []), (None, rows[3][1])] + rows[:40]
    kept, n, sums, v, e, w = slow_whitening(rows)
    found = whitening.whiten(whitening.integer_vectors(vectors(spark, rows))).collect()
    assert len(found) == 16 * len(kept) and {x.n for x in found} == {n}
    by_row = defaultdict(list)
    for x in sorted(found, key=lambda x: x.component):
        by_row[x.vec_id].append(x)
    for i, x in kept:
        raised = [n * a - s for a, s in zip(x, sums)]
        got = by_row[i][:: len(by_row[i]) // 16]
        assert [g.component for g in got] == list(range(1, 17)) and {g.deviation for g in got} == {sum(a * a for a in raised)}
        want = (np.array(raised, float) / n) @ w / np.sqrt(e)
        np.testing.assert_allclose(np.abs([g.whitened for g in got]), np.abs(want), atol=1e-8)
    np.testing.assert_allclose([g.explained for g in by_row[7][::2]], e / np.trace(v), rtol=1e-10)
    assert found[0].identity_error < 1e-10 and len({x.identity_error for x in found}) == 1
    fit = {tuple(x): i for i, x in kept}
    white = np.array([[g.whitened for g in by_row[i][:: len(by_row[i]) // 16]] for i in fit.values()])
    assert np.abs(white.T @ white / n - np.eye(16)).max() < 1e-8


def test_whitening_of_few_vectors(spark):
    """No variance, no rows; as many components as there is variance for."""
    white = lambda rows: whitening.whiten(whitening.integer_vectors(vectors(spark, rows))).collect()
    assert white([]) == [] and white([(1, [1.0, 2.0])]) == [] and white([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    found = white([(1, [1.0, 2.0]), (2, [4.0, -2.0]), (3, [4.0, -2.0])])
    assert [(x.vec_id, x.component) for x in sorted(found)] == [(1, 1), (2, 1), (3, 1)]
    assert all(abs(abs(x.whitened) - 1) < 1e-12 and abs(x.explained - 1) < 1e-12 for x in found)


def test_deviations_are_exact():
    x = np.array([[3 * 10**9, 1], [0, -(10**9)]], np.int64)
    assert whitening.deviations(x).tolist() == [9 * 10**18 + 1, 10**18]
    with pytest.raises(OverflowError):
        whitening.deviations(x * 10)


def test_vectors_of_different_lengths(spark):
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(whitening.integer_vectors(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [3.0])]))).collect()
