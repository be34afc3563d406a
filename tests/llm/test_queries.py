"""The registered queries against SQL or brute force on the smallest tables, and the pipeline stage by stage."""

import glob
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ["op6_line_quality", "op9_warc"])
def test_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    found = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    order = [df.columns.index(c) for c in columns]
    assert sorted(repr([r[i] for i in order]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


def test_held_out_accuracy(spark, db):
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = entry.queries()["op5_language_id"](spark, SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    quality = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = entry.queries()["op10_knn_quality"](spark, SMALL).collect()
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pipeline(spark, db, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns, name
            assert after.join(docs, "doc_id", "left_anti").count() == 0
            sizes.append(after.count())
        docs = after
    good = {i for (i,) in db.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "1")).collect()}
    assert len(good & kept) >= 0.97 * len(good)
    before = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    seen, total = set(), 0
    for r in sorted(spark.read.parquet(str(tmp_path / "3")).collect(), key=lambda r: r.doc_id):
        b = before[r.doc_id].encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            w = hashlib.md5(b[p : p + 100]).digest()
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        assert r.text == bytes(x for x, m in zip(b, mark) if not m).decode("utf-8", "ignore") and r.n_chars == len(r.text)
        total += 1
    assert total == sizes[-1] and docs.select("doc_id").distinct().count() == total


def test_pipeline_of_odd_rows(spark, db, tmp_path):
    """Null ids and texts, repeated rows and ids, empty and very long texts, extra columns, an empty table."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    english = docs.where("lang = 'en'").orderBy("doc_id").limit(3)
    odd = english.withColumn("doc_id", F.lit(None).cast("long")).unionByName(english).unionByName(english.withColumn("text", F.lit(None).cast("string"))).unionByName(english.withColumn("text", F.lit("")))
    odd = odd.unionByName(english.withColumn("doc_id", F.lit(10**9)).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 300)))
    wide = docs.unionByName(odd)
    for name in ("id", "tie", "_id", "k0", "fp", "node", "key", "ranges", "score", "piece", "length"):
        wide = wide.withColumn(name, F.lit("x"))
    for rows, label in ((wide, "odd"), (wide.where("doc_id < 0"), "none")):
        now, columns = rows, rows.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{label}{k}")
            stage(spark, now, SMALL).write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == columns, name
            if k == 2 and label == "odd":
                ids = [r.doc_id for r in now.select("doc_id").collect()]
                assert ids.count(None) == 3 and len({i for i in ids if i is not None}) == len(ids) - 3
                assert now.where("text is null or text = ''").count() == 0
        assert (now.count() == 0) == (label == "none")


def slow_components(sets):
    """Groups of a Jaccard similarity of 0.8 or more, by comparing every set with all others."""
    group = {}
    keys = sorted(sets)
    for n, i in enumerate(keys):
        group[i] = i
        for j in keys[:n]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_near_duplicates_of_whole_tables(spark, db):
    import corpus_pipeline

    for folder in (SMALL, SMALL.replace("0.001", "0.01")):
        rows = db.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
        sets = {}
        for i, t in rows:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        want = slow_components(sets)
        kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id").collect()
        assert sorted(r.doc_id for r in kept) == sorted({g for g in want.values()})


def test_removed_passages_of_whole_tables(spark, db):
    for folder in (SMALL, SMALL.replace("0.001", "0.01")):
        rows = db.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY 1").fetchall()
        seen, want = set(), {}
        for i, t in rows:
            b = (t or "").encode()
            mark = bytearray(len(b))
            for p in range(len(b) - 99):
                w = hash(b[p : p + 100])
                if w in seen:
                    mark[p : p + 100] = b"\1" * 100
                seen.add(w)
            want[i] = (len(b), sum(mark), hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
        got = entry.queries()["op8_suffix_dedup"](spark, folder).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want


def test_ids_of_whole_tables(spark, db):
    """op3 and op7 against their libraries, document by document."""
    import base64
    import zlib

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    folder = SMALL.replace("0.001", "0.01")
    rows = db.execute(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall()
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = {i: (len(x := encode(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert {r.doc_id: tuple(r)[1:] for r in entry.queries()["op3_byte_bpe"](spark, folder).collect()} == want
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    pieces = {}
    for i, t in rows:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        pieces |= {(i, k): (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = entry.queries()["op7_pattern_packing"](spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces
    assert len({r.sequence_id for r in got}) <= -(-sum(p[1] for p in pieces.values()) // 2048)


def test_all_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
