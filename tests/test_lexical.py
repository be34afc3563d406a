"""Lexical retrieval on made-up notes about a harbour; expected values come from SQL over the same rows."""

import random

import duckdb
import pytest

from irspan.functions.porter2 import stem
from irspan.functions.text import NO_STEM, PLAIN, Tokenizer
from irspan.operators import physical
from irspan.operators.bm25 import BM25Retriever, LexicalIndex, MultiFieldBM25Retriever
from irspan.operators.rm3 import RM3Retriever

WORDS = "harbour crane ferry pilot tide rope anchor signal fog lantern cargo quay winch buoy".split()


def notes(seed=5, n=40):
    r = random.Random(seed)
    made = [(f"n{i:02}", " ".join(r.choices(WORDS, k=r.randrange(0, 4))), " ".join(r.choices(WORDS, weights=range(1, 15), k=r.randrange(0, 18)))) for i in range(n)]
    return [*made, ("n98", None, "tide tide tide"), ("n99", "fog", None)]


ASKED = [("a", "ferry tide"), ("b", "lantern lantern quay"), ("c", "winch"), ("d", "zeppelin"), ("e", "")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(notes(), "doc_id string, title string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(ASKED, "query_id string, text string")


def expected(k1, b, weights=None):
    """Scores by SQL: one field of title and text, or two fields with weights."""
    db = duckdb.connect()
    db.execute("CREATE TABLE notes (id VARCHAR, title VARCHAR, body VARCHAR)")
    db.executemany("INSERT INTO notes VALUES (?, ?, ?)", notes())
    db.execute("CREATE TABLE asked (q VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO asked VALUES (?, ?)", ASKED)
    fields = [("both", "concat_ws(' ', title, body)", 1.0)] if weights is None else [("title", "title", weights[0]), ("body", "body", weights[1])]
    views = " UNION ALL ".join(f"SELECT '{f}' AS f, {w}::DOUBLE AS fw, id, coalesce({c}, '') AS t FROM notes" for f, c, w in fields)
    rows = db.execute(f"""WITH v AS ({views}), w AS (SELECT f, fw, id, unnest(string_split(t, ' ')) AS term FROM v), words AS (SELECT * FROM w WHERE term <> ''),
      len AS (SELECT v.f, v.id, count(words.term) AS n FROM v LEFT JOIN words ON words.f = v.f AND words.id = v.id GROUP BY ALL), avg_len AS (SELECT f, avg(n) AS a, count(*) AS docs FROM len GROUP BY 1),
      tf AS (SELECT f, fw, id, term, count(*) AS c FROM words GROUP BY ALL), df AS (SELECT f, term, count(*) AS d FROM tf GROUP BY ALL),
      ask AS (SELECT q, unnest(string_split(text, ' ')) AS term FROM asked)
      SELECT q, id, sum(fw * ln(1 + (docs - d + 0.5) / (d + 0.5)) * c * ({k1} + 1) / (c + {k1} * (1 - {b} + {b} * n / a))) AS s
      FROM ask JOIN tf USING (term) JOIN df USING (f, term) JOIN len USING (f, id) JOIN avg_len USING (f) WHERE fw <> 0 GROUP BY ALL HAVING s > 0""").fetchall()
    return {(q, i): s for q, i, s in rows}


def scores(run):
    return {(r.query_id, r.doc_id): r.score for r in run.collect()}


@pytest.mark.parametrize(("k1", "b"), [(0.9, 0.4), (2.0, 1.0), (0.0, 0.7), (1.1, 0.0)])
def test_one_field(corpus, queries, k1, b):
    found = scores(BM25Retriever(k1, b, PLAIN).index(corpus).retrieve(queries, 1000))
    assert found == pytest.approx(expected(k1, b), abs=2e-6) and {q for q, _ in found} == {"a", "b", "c"}


@pytest.mark.parametrize("weights", [(1.0, 1.0), (2.5, 0.5), (0.0, 1.0)])
def test_two_fields(corpus, queries, weights):
    found = scores(MultiFieldBM25Retriever(weights=weights, tokenizer=PLAIN).index(corpus).retrieve(queries, 1000))
    assert found == pytest.approx(expected(0.9, 0.4, weights), abs=2e-6)


def test_an_index_is_opened_again(spark, corpus, queries, tmp_path):
    index = LexicalIndex.build(corpus, PLAIN, folder=str(tmp_path / "index"))
    again = LexicalIndex.open(spark, str(tmp_path / "index"))
    run = lambda i: scores(BM25Retriever(tokenizer=PLAIN, indexed=i).retrieve(queries))
    assert index.there() and run(index) == run(again)
    assert again.lengths.count() == len(notes()) and again.postings().agg({"tf": "sum"}).first()[0] == again.lengths.agg({"dl": "sum"}).first()[0]
    index.drop()
    assert not again.there()


def test_stems_of_a_vocabulary(spark):
    """Stemming each term once gives what stemming every token gives."""
    rows = spark.createDataFrame([("x", "", "The ferries ferried FERRYING anglers' anchors anchoring"), ("y", "sailing", "a sailor sailed; sails are sailing"), ("z", "", "")], "doc_id string, title string, text string")
    for t in (Tokenizer(), Tokenizer(None), Tokenizer(min_length=5)):
        index = LexicalIndex.build(rows, t)
        counted = {}
        for r in rows.select("doc_id", t(rows.text).alias("a"), t(rows.title).alias("b")).collect():
            for term in [*r.a, *r.b]:
                counted[r.doc_id, term] = counted.get((r.doc_id, term), 0) + 1
        assert {(r.doc_id, r.term): r.tf for r in index.postings().collect()} == counted
        assert {r.doc_id: r.dl for r in index.lengths.collect()} == {d: sum(n for (e, _), n in counted.items() if e == d) for d in "xyz"}


@pytest.mark.parametrize(("word", "want"), [("anglers", "angler"), ("ferries", "ferri"), ("sailing", "sail"), ("tied", "tie"), ("mooring", "moor"), ("national", "nation"), ("hopefully", "hope"), ("skis", "ski"), ("at", "at"), ("dying", "die")])
def test_stems(word, want):
    assert stem(word) == want


def test_what_is_refused(spark, corpus, queries):
    for bad in (lambda: BM25Retriever(-0.1), lambda: BM25Retriever(b=1.01), lambda: MultiFieldBM25Retriever(weights=(1.0,)), lambda: MultiFieldBM25Retriever(()), lambda: RM3Retriever(alpha=1.2), lambda: RM3Retriever(fb_docs=-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        BM25Retriever().retrieve(queries)
    with pytest.raises(ValueError, match="empty"):
        BM25Retriever().index(corpus.where("doc_id = 'none'"))
    with pytest.raises(ValueError, match="positive"):
        BM25Retriever(tokenizer=PLAIN).index(corpus).retrieve(queries, 0)


def test_feedback_terms(spark):
    """Two feedback notes with shares 3/4 and 1/4: every weight is a fraction that can be counted."""
    rows = spark.createDataFrame([("p", "", "rope rope quay quay"), ("q", "", "quay fog fog fog"), ("r", "", "buoy")], "doc_id string, title string, text string")
    r = RM3Retriever(fb_docs=2, fb_terms=9, tokenizer=PLAIN).index(rows)
    feedback = spark.createDataFrame([("x", "p", 6.0), ("x", "q", 2.0), ("y", "r", 1.0)], "query_id string, doc_id string, score double")
    model = {(t.query_id, t.term): t.weight for t in r.relevance_model(feedback).collect()}
    assert model == pytest.approx({("x", "rope"): 6 / 16, ("x", "quay"): 7 / 16, ("x", "fog"): 3 / 16, ("y", "buoy"): 1.0})
    two = {t.term: t.weight for t in r.with_parameters(fb_terms=2).relevance_model(feedback).where("query_id = 'x'").collect()}
    assert two == pytest.approx({"quay": 7 / 13, "rope": 6 / 13})


def test_feedback_leaves_queries_as_they_are(spark, corpus, queries):
    plain = scores(BM25Retriever(tokenizer=PLAIN).index(corpus).retrieve(queries, 1000))
    lengths = {q: len(t.split()) for q, t in ASKED}
    r = RM3Retriever(tokenizer=PLAIN).index(corpus)
    for same in ({"alpha": 0.0}, {"fb_docs": 0}, {"fb_terms": 0}):
        assert scores(r.with_parameters(**same).retrieve(queries, 1000)) == pytest.approx({(q, d): s / lengths[q] for (q, d), s in plain.items()}, abs=2e-6)
    mixed = {(t.query_id, t.term): t.weight for t in r.expanded_queries(queries).collect()}
    assert mixed["d", "zeppelin"] == 1.0 and sum(w for (q, _), w in mixed.items() if q == "a") == pytest.approx(1.0)


def test_query_statistics(spark):
    rows = spark.createDataFrame([("1", "", "crane"), ("2", "", "crane winch"), ("3", "", "winch tide")], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("u", "crane crane tide gull"), ("v", "")], "query_id string, text string")
    stats = {r.query_id: r for r in BM25Retriever(tokenizer=NO_STEM).index(rows).query_statistics(asked).collect()}
    idf = {r.term: r.idf for r in BM25Retriever(tokenizer=NO_STEM).index(rows).indexed.terms.collect()}
    assert stats["u"].max_idf == idf["tide"] and stats["u"].mean_idf == pytest.approx((2 * idf["crane"] + idf["tide"]) / 3)
    assert (stats["u"].num_terms, stats["u"].num_in_vocabulary, stats["u"].out_of_vocabulary_rate) == (4, 3, 0.25)
    assert (stats["v"].max_idf, stats["v"].num_terms, stats["v"].out_of_vocabulary_rate) == (0, 0, 0)
    with pytest.raises(ValueError, match="one field"):
        MultiFieldBM25Retriever(tokenizer=NO_STEM).index(rows).query_statistics(asked)


def test_physical_choices_keep_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 3)], "doc_id string, n int")
    rows = sorted(map(repr, df.collect()))
    assert sorted(map(repr, physical.spread(df, "doc_id").collect())) == rows
    assert sorted(map(repr, physical.written(df, "test").collect())) == rows
    empty = physical.written(df.where("n > 9"), "test")
    assert empty.columns == ["doc_id", "n"] and not empty.count()
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(physical.small(df, 4)) and "ResolvedHint" not in plan(physical.small(df, physical.BROADCAST_ROWS + 1))

    class Elsewhere:
        conf = type("c", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("s", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="share"):
        physical.shared_folder(Elsewhere, "x")


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_running_sums_over_ranges(spark, partitions):
    r = random.Random(1)
    rows = [(r.randrange(50), i, r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "v int, i int, w int").repartition(5)
    from pyspark.sql import functions as F

    got = {(x.v, x.i): x.s for x in physical.cumulative(df, ["v", "i"], F.col("w"), "s", partitions).collect()}
    total, want = 0, {}
    for v, i, w in sorted(rows):
        total += w
        want[v, i] = total
    assert got == want
    ranks = {x.i: x.rank for x in physical.average_ranks(df, "v", "rank").collect()}
    for v, i, _ in rows:
        below, same = sum(x[0] < v for x in rows), sum(x[0] == v for x in rows)
        assert ranks[i] == below + (same + 1) / 2
    assert physical.cumulative(df.where("v < 0"), ["v", "i"], F.lit(1), "s").count() == 0


def test_terms_are_counted_where_texts_are(spark, monkeypatch):
    """Whatever the tokenizer, counts are those of its tokens; some bytes of text are tokens at a time."""
    from collections import Counter

    import pyarrow as pa
    from irspan.operators import bm25
    from pyspark.sql import functions as F

    texts = ["The cranes, THE dock-7 Kelvin İx", None, "", "of the", "naïve a1 a1 b" * 40, "boats boat boating the"]
    monkeypatch.setattr(bm25, "TEXT_BYTES", 16)
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for tokenizer in (PLAIN, NO_STEM, Tokenizer(), Tokenizer(None, True, 4), Tokenizer(stem=False, min_length=3)):
        rows = frame.select("i", F.lower(F.coalesce("t", F.lit(""))).alias("low"), tokenizer(F.col("t")).alias("tokens")).collect()
        batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(rows)), pa.array([str(r.i) for r in rows]), pa.array([r.low for r in rows])], ["field", "doc_id", "lowered"])
        out = list(bm25._counting(tokenizer)(iter([batch])))
        assert len(out) > 2  # parts of the batch
        found = [x for b in out for x in b.to_pylist()]
        assert [(x["doc_id"], x["dl"], dict(zip(x["terms"], x["tfs"], strict=True))) for x in found] == [(str(r.i), len(r.tokens), dict(Counter(r.tokens))) for r in rows]
