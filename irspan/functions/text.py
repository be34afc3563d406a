"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from irspan.functions.porter2 import stem

# The stop words of Lucene's English analyser.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")

#: A character class like Python's str.isspace, for Java's regular expressions.
_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, rf"^{_WHITE}+|{_WHITE}+$", "")


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, rf"{_WHITE}+"), lambda w: w != "")


@F.pandas_udf(ArrayType(StringType()))
def _stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}

    def one(word: str) -> str:
        found = known.get(word)
        if found is None:
            if len(known) > 500_000:
                known.clear()
            found = known[word] = stem(word)
        return found

    for batch in batches:
        yield batch.map(lambda ws: None if ws is None else [one(w) for w in ws])


@dataclass(frozen=True)
class Tokenizer:
    """Lower case, runs of ASCII letters and digits, stop words out, stems, short tokens out, in this order."""

    stopwords: tuple[str, ...] | None = STOPWORDS
    stem: bool = True
    min_length: int = 1

    def __call__(self, text: Column) -> Column:
        """Array of tokens; a null text has none."""
        tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        if self.stopwords:
            tokens = F.filter(tokens, lambda t: ~t.isin(*self.stopwords))
        if self.stem:
            tokens = _stemmed(tokens)
        if self.min_length > 1:
            tokens = F.filter(tokens, lambda t: F.length(t) >= self.min_length)
        return tokens

    def describe(self) -> dict:
        return {"stopwords": len(self.stopwords or ()), "stemmer": "snowball-english" if self.stem else None, "min_length": self.min_length}


PLAIN = Tokenizer(stopwords=None, stem=False)
NO_STEM = Tokenizer(stem=False)


def document_text(title: Column, text: Column) -> Column:
    """Title and text in one, without white space at the ends."""
    return strip(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def chunks(text: Column, size: int | None, overlap: int = 0) -> Column:
    """Windows of ``size`` words at a stride of ``size - overlap``, short tails kept; the text itself when
    ``size`` is None, one empty chunk for an empty text."""
    if size is None:
        return F.array(text)
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than it")

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size - overlap))
        many = F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))
        return F.when(F.size(w) <= size, F.array(F.array_join(w, " "))).otherwise(many)

    # The words are a variable of the outer function: as an expression they would be split anew for each window.
    return F.transform(F.array(words(F.coalesce(text, F.lit("")))), windows)[0]


def truncation_rate(tokens: Column, limit: int, special: int = 1) -> Column:
    """Aggregate: share of rows with more tokens than ``limit``; 0 over no rows."""
    return F.coalesce(F.avg((F.size(tokens) + special > limit).cast("double")), F.lit(0.0))


def expanded_query(text: Column, passage: Column, weight: int = 1) -> Column:
    """The query ``weight`` times, then the passage; a blank passage leaves the query as it is."""
    if weight < 0:
        raise ValueError("weight can't be negative")
    p = strip(F.coalesce(passage, F.lit("")))
    return F.when(p == "", text).otherwise(strip(F.concat_ws(" ", *([text] * weight), p)))


def expanded_document(text: Column, generations: Column) -> Column:
    """The text followed by the generations that aren't blank."""
    kept = F.filter(F.transform(F.coalesce(generations, F.array().cast("array<string>")), strip), lambda g: g != "")
    return F.when(F.size(kept) == 0, text).otherwise(F.concat_ws(" ", text, F.array_join(kept, " ")))


def added_terms(original: Column, generated: Column, tokenizer: Tokenizer = NO_STEM) -> Column:
    """Distinct terms of ``generated`` that ``original`` doesn't have."""
    return F.array_except(F.array_distinct(tokenizer(generated)), tokenizer(original))


def verdict(answer: Column) -> Column:
    """1, 0 or null from how an answer begins; negative beginnings are tried first."""
    a = F.lower(strip(F.coalesce(answer, F.lit(""))))
    no = F.lit(False)
    for start in ("no", "false", "not relevant", "irrelevant"):
        no = no | a.startswith(start)
    yes = a.startswith("yes") | a.startswith("true") | a.startswith("relevant")
    return F.when(no, 0).when(yes, 1).cast("int")


def citations(answer: Column) -> Column:
    """Distinct numbers in square brackets, as first met."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda c: c.cast("bigint")))


def valid_citations(answer: Column, n: Column) -> Column:
    return F.filter(citations(answer), lambda c: (c >= 1) & (c <= n))


def invalid_citations(answer: Column, n: Column) -> Column:
    return F.filter(citations(answer), lambda c: (c < 1) | (c > n))


def citation_precision(answer: Column, n: Column) -> Column:
    """Share of citations that are valid; null without any."""
    total = F.size(citations(answer))
    return F.when(total > 0, 1 - F.size(invalid_citations(answer, n)) / total)


def source_block(number: Column, title: Column, text: Column, max_chars: int = 700) -> Column:
    """One numbered source of a prompt; without title and text its number alone."""
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    return strip(F.concat(F.lit("["), number.cast("string"), F.lit("] "), clean(title), F.lit("\n"), F.substring(clean(text), 1, max_chars)))


def prepared_ids(ids: Column, mask: Column, marker: int, pad: int, mask_id: int, is_query: bool, skiplist: tuple[int, ...] = ()) -> tuple[Column, Column]:
    """Input ids with the marker at position 1, and which positions are kept: all of a query, whose
    padding becomes mask tokens, and of a document those attended to and not skipped."""
    marked = F.transform(ids, lambda x, i: F.when(i == 1, marker).otherwise(x))
    if is_query:
        out = F.transform(marked, lambda x: F.when(x == pad, mask_id).otherwise(x))
        return out, F.transform(out, lambda x: F.lit(True))
    skipped = F.array(*(F.lit(s) for s in skiplist)) if skiplist else F.array().cast("array<int>")
    return marked, F.transform(marked, lambda x, i: (F.get(mask, i) == 1) & ~F.array_contains(skipped, x))
