"""Text functions as columns, on made-up sentences."""

import pytest
from pyspark.sql import functions as F

from irspan.functions import text as T


def one(spark, column, **values):
    kind = lambda v: "array<string>" if isinstance(v, list) else "string"
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items()))
    return row.select(column).first()[0]


def test_tokens(spark):
    t = F.col("t")
    assert one(spark, T.PLAIN(t), t="Dock-7 opens; B12's crane (naïve)") == ["dock", "7", "opens", "b12", "s", "crane", "na", "ve"]
    assert one(spark, T.NO_STEM(t), t="The crane of the dock and a ferry") == ["crane", "dock", "ferry"]
    assert one(spark, T.Tokenizer()(t), t="the mooring boats are moored") == ["moor", "boat", "moor"]
    assert one(spark, T.Tokenizer(None, True, 5)(t), t="sailing boats harbours") == ["harbour"]
    assert one(spark, T.PLAIN(t), t=None) == one(spark, T.PLAIN(t), t=" ,;") == []
    assert T.Tokenizer().describe() == {"stopwords": 33, "stemmer": "snowball-english", "min_length": 1}


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(7, 3, 0, ["0 1 2", "3 4 5", "6"]), (7, 4, 2, ["0 1 2 3", "2 3 4 5", "4 5 6", "6"]), (3, 9, 1, ["0 1 2"]), (0, 5, 0, [""]), (6, 2, 1, ["0 1", "1 2", "2 3", "3 4", "4 5", "5"])])
def test_windows_of_words(spark, n, size, overlap, want):
    assert one(spark, T.chunks(F.col("t"), size, overlap), t="  ".join(map(str, range(n)))) == want


def test_windows_are_checked(spark):
    for size, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            T.chunks(F.lit(""), size, overlap)
    assert one(spark, T.chunks(F.col("t"), None), t=" as it is ") == [" as it is "]


def test_expanded_texts(spark):
    q = lambda w, p: one(spark, T.expanded_query(F.col("q"), F.col("p"), w), q="night ferry", p=p)
    assert [q(3, " It sails late. "), q(0, "It sails late."), q(2, "\n\t"), q(1, None)] == ["night ferry night ferry night ferry It sails late.", "It sails late.", "night ferry", "night ferry"]
    with pytest.raises(ValueError):
        T.expanded_query(F.lit(""), F.lit(""), -2)
    d = lambda g: one(spark, T.expanded_document(F.col("t"), F.col("g")), t="A quay.", g=g)
    assert [d(["When? ", "", " Where?"]), d(["  "]), d([])] == ["A quay. When? Where?", "A quay.", "A quay."]
    assert sorted(one(spark, T.added_terms(F.col("a"), F.col("b")), a="the quay at night", b="A quay, a night and a LAMP; lamp 9")) == ["9", "lamp"]


@pytest.mark.parametrize(("answer", "want"), [(" YES, it is", 1), ("True.", 1), ("relevantly so", 1), ("Nope", 0), ("  falsehood", 0), ("Irrelevant", 0), ("not relevant at all", 0), ("not sure", 0), ("perhaps", None), (" ", None), (None, None), ("it is relevant", None)])
def test_verdicts(spark, answer, want):
    assert one(spark, T.verdict(F.col("a")), a=answer) == want


@pytest.mark.parametrize(("answer", "n", "valid", "invalid"), [("See [3], [1] and [3].", 4, [3, 1], []), ("[5][2][6]", 5, [5, 2], [6]), ("none [a] [] [ 1 ]", 2, [], []), ("[00] [12]", 9, [], [0, 12]), (None, 3, [], [])])
def test_citations(spark, answer, n, valid, invalid):
    assert one(spark, T.valid_citations(F.col("a"), F.lit(n)), a=answer) == valid
    assert one(spark, T.invalid_citations(F.col("a"), F.lit(n)), a=answer) == invalid
    total = len(valid) + len(invalid)
    assert one(spark, T.citation_precision(F.col("a"), F.lit(n)), a=answer) == (pytest.approx(len(valid) / total) if total else None)


def test_sources(spark):
    block = lambda t, x, n=700: one(spark, T.source_block(F.lit(2), F.col("t"), F.col("x"), n), t=t, x=x)
    assert [block("Quay ", " deep water "), block(None, None), block("", "abcdef", 3)] == ["[2] Quay\ndeep water", "[2]", "[2] \nabc"]


def test_prepared_ids(spark):
    row = spark.createDataFrame([([40, 41, 42, 43, 9, 9], [1, 1, 1, 1, 0, 0])], "ids array<int>, mask array<int>")
    ids, kept = T.prepared_ids(F.col("ids"), F.col("mask"), 77, 9, 88, True)
    assert row.select(ids, kept).first()[:] == ([40, 77, 42, 43, 88, 88], [True] * 6)
    ids, kept = T.prepared_ids(F.col("ids"), F.col("mask"), 77, 9, 88, False, (42, 5))
    assert row.select(ids, kept).first()[:] == ([40, 77, 42, 43, 9, 9], [True, True, False, True, False, False])


def test_truncation(spark):
    rows = spark.createDataFrame([(["a"] * n,) for n in (1, 3, 4, 9)], "t array<string>")
    assert rows.agg(T.truncation_rate(F.col("t"), 4)).first()[0] == 0.5
    assert rows.where("size(t) > 99").agg(T.truncation_rate(F.col("t"), 4)).first()[0] == 0.0


def test_words_are_split_once_for_all_windows(spark):
    """A long text's windows take time in proportion to it: its words are not split again for each of them."""
    import time

    from irspan.functions.text import chunks

    text = " ".join(f"w{i}" for i in range(60_000))
    frame = spark.createDataFrame([(text,)], "text string")
    start = time.time()
    found = frame.select(F.explode(chunks(F.col("text"), 10, 2)).alias("c")).agg(F.count("*"), F.min("c"), F.max("c")).first()
    assert found[0] == 7500 and time.time() - start < 30
