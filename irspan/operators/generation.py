"""Running text models over frames: expansions, relevance verdicts and cited answers.

A model is a plug-in: a picklable callable from a list of prompts and the settings to a list of texts a
prompt.  None is shipped; what is here is the batching, the prompts and the record of how a text was made.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irspan.functions.text import citations, invalid_citations, valid_citations

#: How the questions are put to a model; the placeholders are filled in.
JUDGE_PROMPT = "Someone searched for: {query}\nA search engine returned this text:\n{document}\nWould it help them? Say yes or no:"
ANSWER_PROMPT = "{sources}\n\nAnswer the question from these sources alone, with their numbers in brackets like [1].\nQuestion: {query}\nAnswer:"


@dataclass(frozen=True)
class Settings:
    """How texts are generated; several a prompt need sampling, as the best one is always the same."""

    model: str = "plug-in"
    generations: int = 1
    max_new_tokens: int = 128
    batch_size: int = 16
    seed: int = 0
    sample: bool = False

    def __post_init__(self) -> None:
        if self.generations < 1 or self.batch_size < 1:
            raise ValueError("generations and batch_size must be positive")
        if self.generations > 1 and not self.sample:
            raise ValueError("several generations without sampling would be the same text again")

    def describe(self, kind: str) -> dict:
        return {"method": kind, **asdict(self)}


def _seed(seed: int, ids: list[str]) -> int:
    return zlib.crc32("\n".join([str(seed), *map(str, ids)]).encode())


Model = Callable[[list[str], Settings], list[list[str]]]


def _generated(prompts: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """id and generations for rows of id and prompt.

    Rows are dealt out and sorted by id.  A sampling model gets a seed of its own for each batch, made of the
    settings' seed and the batch's ids: batches differ, and the same batch is made alike again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, settings.batch_size):
                part = batch.slice(at, settings.batch_size)
                own = replace(settings, seed=_seed(settings.seed, part.column(0).to_pylist())) if settings.sample else settings
                texts = model(part.column(1).to_pylist(), own)
                if len(texts) != part.num_rows or any(len(t) != settings.generations for t in texts):
                    raise ValueError("the model must give the asked number of texts for every prompt")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[x.strip() for x in t] for t in texts], pa.list_(pa.string()))], ["id", "generations"])

    return prompts.repartition("id").sortWithinPartitions("id").mapInArrow(run, "id string, generations array<string>")


def generate(texts: DataFrame, model: Model, settings: Settings = Settings(), prompt: str | None = None, limit: int | None = None) -> DataFrame:
    """id and generations for ``texts`` (id, text), put into ``prompt`` at {text}; ``limit``: of the first ids only."""
    rows = texts.select(F.col("id").cast("string"), F.coalesce("text", F.lit("")).alias("prompt"))
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    if prompt is not None:
        before, after = prompt.split("{text}")
        rows = rows.withColumn("prompt", F.concat(F.lit(before), "prompt", F.lit(after)))
    return _generated(rows, model, settings)


def judge(pairs: DataFrame, model: Model, settings: Settings = Settings(max_new_tokens=4), max_chars: int = 1200) -> DataFrame:
    """``pairs`` (query_id, doc_id, query_text, document) with the model's ``answer`` about the document's
    first ``max_chars`` characters."""
    a, rest = JUDGE_PROMPT.split("{query}")
    b, c = rest.split("{document}")
    key = F.to_json(F.struct("query_id", "doc_id"))
    rows = pairs.withColumn("id", key)
    prompts = rows.select("id", F.concat(F.lit(a), F.coalesce("query_text", F.lit("")), F.lit(b), F.substring(F.coalesce("document", F.lit("")), 1, max_chars), F.lit(c)).alias("prompt"))
    answers = _generated(prompts.dropDuplicates(["id"]), model, settings).select("id", F.get("generations", F.lit(0)).alias("answer"))
    return rows.join(answers, "id").drop("id")


def answer(sources: DataFrame, queries: DataFrame, run: DataFrame, model: Model, settings: Settings = Settings(max_new_tokens=160)) -> DataFrame:
    """An answer for every query from its numbered sources (query_id, sources), with its citations checked:
    query_id, query, answer, doc_ids, cited_positions, cited_doc_ids, invalid_citations, uncited and
    citation_precision (null without a citation).  A query without a source has no row."""
    a, rest = ANSWER_PROMPT.split("{sources}")
    b, c = rest.split("{query}")
    rows = sources.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    prompts = rows.select(F.col("query_id").alias("id"), F.concat(F.lit(a), "sources", F.lit(b), F.coalesce("query", F.lit("")), F.lit(c)).alias("prompt"))
    answers = _generated(prompts, model, settings).select(F.col("id").alias("query_id"), F.get("generations", F.lit(0)).alias("answer"))
    ids = run.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))  # of a run's depth
    rows = answers.join(rows.select("query_id", "query"), "query_id").join(ids, "query_id")
    n = F.size("doc_ids")
    valid, wrong = valid_citations(F.col("answer"), n), invalid_citations(F.col("answer"), n)
    total = F.size(citations(F.col("answer")))
    return rows.select(
        "query_id",
        "query",
        "answer",
        "doc_ids",
        F.concat(valid, wrong).alias("cited_positions"),
        F.transform(valid, lambda p: F.get("doc_ids", p.cast("int") - 1)).alias("cited_doc_ids"),
        wrong.alias("invalid_citations"),
        (total == 0).alias("uncited"),
        F.when(total > 0, 1 - F.size(wrong) / total).alias("citation_precision"),
    )
