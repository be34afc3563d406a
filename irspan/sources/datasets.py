"""Datasets on disk: JSONL corpora and queries, TSV judgements, records of results, stored expansions.

Tables: corpus(doc_id, title, text), queries(query_id, text), qrels(query_id, doc_id, grade).
"""

from __future__ import annotations

import json
import shutil
import urllib.request
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where archives of the public benchmark collection are fetched from.
ARCHIVES = "https://public.ukp.informatik.tu-darmstadt.de/thakur/BEIR/datasets/{name}.zip"


@dataclass(frozen=True)
class Dataset:
    """A corpus with the queries of one split and their judgements."""

    name: str
    split: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are passed over, a malformed one fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    empty = F.lit("")
    return read_jsonl(spark, path, "_id string, title string, text string").select(F.col("_id").alias("doc_id"), F.coalesce("title", empty).alias("title"), F.coalesce("text", empty).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "_id string, text string").select(F.col("_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query, document and grade; a header is passed over where it is the first line of its
    file, as are rows of fewer cells; of several grades of one pair the last one stands."""
    line = F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("at"))
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"), line.alias("line"))
    firsts = F.broadcast(rows.groupBy("line.file_path").agg(F.min("line.at").alias("first")))  # a row a file
    cell = lambda i: F.trim(F.get("c", F.lit(i)))
    rows = rows.select("c", F.col("line.file_path").alias("file_path"), F.col("line.at").alias("at")).join(firsts, "file_path")
    header = (F.col("at") == F.col("first")) & F.coalesce(F.lower(cell(0)).isin("query-id", "query_id"), F.lit(False))
    rows = rows.where(~header & (F.size("c") >= 3))
    return rows.groupBy(cell(0).alias("query_id"), cell(1).alias("doc_id")).agg(F.max_by(cell(2), "at").cast("double").cast("int").alias("grade"))


def field_at(record: Column, path: str) -> Column:
    """The value at a dotted path of a JSON string, or the empty string."""
    return F.coalesce(F.get_json_object(record, f"$.{path}"), F.lit(""))


def formulated_queries(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """query_id and text put together from the dotted ``fields`` that aren't empty."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.filter(F.array(*(field_at(F.col("value"), f) for f in fields)), lambda p: p != "")
    return lines.select(field_at(F.col("value"), "_id").alias("query_id"), F.array_join(parts, " ").alias("text"))


def available_formulations(spark: SparkSession, path: str, formulations: dict[str, list[str]]) -> list[str]:
    """Those formulations all of whose fields occur somewhere."""
    fields = sorted({f for fs in formulations.values() for f in fs})
    lines = spark.read.text(path).where(F.trim("value") != "")
    found = lines.agg(*(F.max(field_at(F.col("value"), f) != "").alias(f"f{i}") for i, f in enumerate(fields))).first()
    there = {f for f, yes in zip(fields, found, strict=True) if yes}
    return [name for name, fs in formulations.items() if set(fs) <= there]


def splits(spark: SparkSession, base: str) -> list[str]:
    """Names of a dataset's splits, wherever its folder is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/qrels")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
    return sorted(n.removesuffix(".tsv") for n in found if n.endswith(".tsv"))


def load_dataset(spark: SparkSession, name: str, split: str = "test", folder: str = "data", validate: bool = True) -> Dataset:
    """A dataset's split from ``folder``/``name``: its judged queries only.  A split that isn't there, or a
    judged query without a text, is an error."""
    base = f"{folder}/{name}"
    there = splits(spark, base)
    if split not in there:
        raise ValueError(f"{name} has no split {split}; it has {', '.join(there) or 'none'}")
    qrels = read_qrels(spark, f"{base}/qrels/{split}.tsv")
    judged = qrels.select("query_id").distinct()
    queries = read_queries(spark, f"{base}/queries.jsonl")
    if validate:
        lost = judged.join(queries, "query_id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"query {lost[0][0]} is judged but has no text")
    return Dataset(name, split, read_corpus(spark, f"{base}/corpus.jsonl"), queries.join(judged, "query_id", "left_semi"), qrels)


def download_dataset(name: str, folder: str = "data", url: str = ARCHIVES) -> Path:
    """Fetch and unpack a dataset's archive, unless it is there."""
    target = Path(folder) / name
    if (target / "corpus.jsonl").exists():
        return target
    Path(folder).mkdir(parents=True, exist_ok=True)
    archive = Path(folder) / f"{name}.zip"
    with urllib.request.urlopen(url.format(name=name)) as response, archive.open("wb") as out:
        shutil.copyfileobj(response, out, 1 << 20)
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
    archive.unlink()
    if not (target / "corpus.jsonl").exists():
        raise ValueError(f"the archive of {name} has no corpus")
    return target


def corpus_digest(corpus: DataFrame) -> DataFrame:
    """One row: 16 hexadecimal digits over ids, titles and texts, whatever their order."""
    one = F.sha2(F.concat_ws("\x00", "doc_id", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    halves = [F.sum(F.conv(F.substring(one, at, 8), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")) for at in (1, 9, 17, 25)]
    return corpus.agg(F.count("*").alias("documents"), *(h.alias(f"h{i}") for i, h in enumerate(halves))).select("documents", F.substring(F.sha2(F.concat_ws(":", F.col("documents").cast("string"), *(F.coalesce(F.col(f"h{i}"), F.lit(0)).cast("string") for i in range(4))), 256), 1, 16).alias("digest"))


def cached_embeddings(corpus: DataFrame, encoder, folder: str, settings: dict) -> DataFrame:
    """Embeddings of ``corpus`` kept as Parquet under its digest and the model's settings."""
    digest = corpus_digest(corpus).first()["digest"]
    key = "-".join([*(f"{k}={settings[k]}" for k in sorted(settings)), digest]).replace("/", "_")
    path, spark = f"{folder}/{key}", corpus.sparkSession
    try:
        found = spark.read.parquet(path)
    except Exception as e:  # only a path that isn't there means that nothing is kept
        if "PATH_NOT_FOUND" not in str(e):
            raise
        encoder.encode(corpus).write.parquet(path)
        return spark.read.parquet(path)
    if found.select("doc_id").distinct().count() != corpus.count():
        raise ValueError(f"{path} is of another corpus")
    return found


def write_results(summary: DataFrame, per_query: DataFrame, folder: str, run_id: str) -> None:
    """A run's summary as JSON, and its values by query as Parquet partitioned by metric."""
    summary.withColumn("per_query", F.lit(f"per-query/{run_id}")).coalesce(1).write.mode("overwrite").json(f"{folder}/{run_id}")
    per_query.write.mode("overwrite").partitionBy("metric").parquet(f"{folder}/per-query/{run_id}")


def read_per_query(spark: SparkSession, folder: str, run_id: str, metric: str) -> DataFrame:
    """query_id and value of one metric of a run, by its summary's pointer."""
    summary = spark.read.json(f"{folder}/{run_id}")
    if "per_query" not in summary.columns:
        raise ValueError(f"{run_id} points to no values by query")
    rows = spark.read.parquet(f"{folder}/{summary.first()['per_query']}").where(F.col("metric") == metric)
    if rows.limit(1).count() == 0:
        raise KeyError(f"{run_id} has no {metric}")
    return rows.select("query_id", "value")


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """id and generations: a folder of :func:`write_expansions`, or one stored record with a map of expansions."""
    lines = spark.read.text(path)
    if "kind" in lines.columns:
        rows = lines.where("kind = 'expansions'").select(F.from_json("value", "id string, generations array<string>", {"mode": "FAILFAST"}).alias("r"))
        return rows.select("r.id", "r.generations")
    record = spark.read.schema("expansions map<string,array<string>>").option("multiLine", True).json(path)
    return record.select(F.explode("expansions").alias("id", "generations"))


def read_settings(spark: SparkSession, path: str) -> dict:
    """The settings that expansions were written with."""
    return json.loads(spark.read.text(path).where("kind = 'settings'").first().value)


def write_expansions(expansions: DataFrame, path: str, settings: dict) -> None:
    """id and generations as JSON lines, as many files as there are tasks, beside their settings."""
    rows = expansions.select(F.lit("expansions").alias("kind"), F.to_json(F.struct("id", "generations")).alias("value"))
    own = expansions.sparkSession.createDataFrame([("settings", json.dumps(settings))], "kind string, value string")
    rows.unionByName(own).write.mode("overwrite").partitionBy("kind").text(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON record in a folder of its own."""
    spark.createDataFrame([(json.dumps(record, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)
