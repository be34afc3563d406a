"""Quality rules, line first, in DataFrame operations only.

Every line is tried by itself: it fails without punctuation (at its end, or a sentence
end for every :data:`WORDS_A_SENTENCE` words), with too many symbols or
doubled marks for its words, as a navigation line (several separators) or as boilerplate (fixed
phrases).  Failing lines are removed; a document that loses more than :data:`MOST_LOST` per cent of
the characters of its words is rejected.  Lines without a word are neither kept nor lost.

Defined cases: a null or empty text has no words; a text with fewer than 50 words, or with more than half
of its words in repeated three-word windows, fails the base rules.  Equal rows give equal rows; an empty
table gives none; a very long text is measured whole, in one row.  Extra columns, whatever their names,
are not looked at.  Windows are compared by 64-bit hashes of their three words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

#: Per cent of a document's word characters that failing lines may take.
MOST_LOST = 50
#: Symbols, or doubled marks, in a line for so many words are too many; separators that make a menu.
WORDS_A_SYMBOL, SEPARATORS = 5, 3
#: A line that ends without punctuation passes as prose with a sentence end for so many words.
WORDS_A_SENTENCE = 40

# Patterns, in the syntax that Java and RE2 share.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES, CLOSERS, TERMINALS = " \t\n\x0b\f\r", "\"'”’»)]", ".!?…:;。！？"
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*[\x20\x09]"
DOUBLED = r"[!?]{2,}|\.{4,}"
SEPARATOR = r"[|»›•·→]|[\x20][>/][\x20]"
PHRASES = ("lorem ipsum", "javascript", "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright ©", "click here", "read more", "sign up", "sign in", "log in", "subscribe", "newsletter", "share this", "share on", "powered by", "follow us", "skip to main content", "skip to content", "back to top")
BOILERPLATE = r"(?i)lorem ipsum|javascript|cookie|privacy policy|terms of (use|service)|all rights reserved|copyright ©|click here|read more|sign up|sign in|log in|subscribe|newsletter|share (this|on)|powered by|follow us|skip to (main )?content|back to top"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _phrased(lower: Column) -> Column:
    """Whether a text has a phrase of boilerplate anywhere: its lines needn't be tried if not."""
    return reduce(Column.__or__, (F.contains(lower, F.lit(p)) for p in PHRASES))


def _repeated_words(hashes: Column) -> Column:
    """Windows that are found twice or more, by hash and place; hashes: of all windows, in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), ordered)


def measure(docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with the base measures, ``base_failed``, ``n_lines``, ``n_lines_kept``,
    ``lost_chars``, ``cleaned`` (the kept lines, joined by line ends) and ``kept``.  No shuffle."""
    k = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(a) for c, a in zip(keep, k, strict=True)), F.coalesce(text_column, F.lit("")).alias("text"))
    rows = rows.select(*k, "text", _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *k,
        "lines",
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("hashes"),
        _phrased(F.lower("text")).alias("phrased"),
    )
    rows = rows.withColumn("ordered", _repeated_words(F.col("hashes"))).drop("hashes")
    same = lambda i, x: F.coalesce(F.get("ordered", i)["h"] == x["h"], F.lit(False))
    found = F.filter("ordered", lambda x, i: same(i - 1, x) | same(i + 1, x))
    rows = rows.withColumn("at", F.sort_array(F.transform(found, lambda x: x["i"]))).drop("ordered")
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")
    rows = rows.withColumn("judged", F.transform("lines", lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))))
    judged = lambda phrased: F.transform("judged", lambda x: F.struct(x["line"].alias("line"), _line_passes(x["line"], x["n"], phrased).alias("good")))
    rows = rows.withColumn("judged", F.when(F.col("phrased"), judged(True)).otherwise(judged(False)))
    rows = rows.withColumn("good", F.transform(F.filter("judged", lambda x: x["good"]), lambda x: x["line"]))
    lost = F.aggregate(F.filter("judged", lambda x: ~x["good"]), F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x["line"], SPACE, "")))
    rows = rows.withColumn("lost_chars", lost)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        *(F.col(a).alias(c) for c, a in zip(keep, k, strict=True)),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("good").cast("long").alias("n_lines_kept"),
        "lost_chars",
        F.array_join("good", "\n").alias("cleaned"),
        (~failed & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))).alias("kept"),
    )


def _ends_in_punctuation(line: Column) -> Column:
    """The pattern TERMINAL, read from the line's end."""
    stripped = lambda x, marks: F.rtrim(x, F.lit(marks))
    return F.right(stripped(stripped(line, SPACES), CLOSERS), F.lit(1)).isin(*TERMINALS)


def _line_passes(line: Column, n_words: Column, phrased: bool) -> Column:
    """Whether a line with a word passes all rules; phrased: its text has a phrase of boilerplate."""
    passes = (
        (_ends_in_punctuation(line) | (WORDS_A_SENTENCE * F.regexp_count(line, F.lit(SENTENCE_END)) >= n_words))
        & (WORDS_A_SYMBOL * F.regexp_count(line, F.lit(SYMBOL)) <= n_words)
        & (WORDS_A_SYMBOL * F.regexp_count(line, F.lit(DOUBLED)) <= n_words)
        & (F.regexp_count(line, F.lit(SEPARATOR)) < SEPARATORS)
    )
    return passes & ~line.rlike(BOILERPLATE) if phrased else passes


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict of the line rules for every document."""
    return measure(common.spread(common.table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_line_quality": op6_line_quality}


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLES = {
    "op6_line_quality": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, {_sql(SPACE)}), lambda x: x <> '') AS words FROM d),
win AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) AS s(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (
  SELECT r, line, len(list_filter(string_split_regex(line, {_sql(SPACE)}), lambda x: x <> '')) AS n,
    length(regexp_replace(line, {_sql(SPACE)}, '', 'g')) AS chars,
    len(regexp_extract_all(line, {_sql(SYMBOL)})) AS symbols, len(regexp_extract_all(line, {_sql(DOUBLED)})) AS doubled,
    len(regexp_extract_all(line, {_sql(SEPARATOR)})) AS separators, len(regexp_extract_all(line, {_sql(SENTENCE_END)})) AS ends
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS dups, sum(chars) AS chars,
    sum(chars) FILTER (WHERE (regexp_matches(line, {_sql(TERMINAL)}) OR {WORDS_A_SENTENCE} * ends >= n) AND {WORDS_A_SYMBOL} * symbols <= n AND {WORDS_A_SYMBOL} * doubled <= n
      AND separators < {SEPARATORS} AND NOT regexp_matches(line, {_sql(BOILERPLATE)})) AS good
  FROM l GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, {_sql(SYMBOL)}))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0)::BIGINT AS good
  FROM w LEFT JOIN covered USING (r) LEFT JOIN by_doc USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - good) <= {MOST_LOST} * word_chars AS kept
FROM f""",
}
