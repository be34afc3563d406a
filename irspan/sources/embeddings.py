"""Embeddings that are kept: only documents that are new or changed are encoded.

A store is a folder for a model and its settings.  Each update writes one table of what it had to encode
(doc_id, digest of the text, embedding) and then a manifest that lists the tables that count; a manifest counts
once it is whole, so an update that fails half-way leaves the store as it was.  What is there is found by a
join of ids and digests, without the vectors.

Defined cases: a null text is an empty one; a row whose id and text are there already is not encoded again; a document
that has its former text again is found under it; ids that repeat with different texts are embeddings of their own,
equal rows one; an empty corpus gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.operators.physical import drop, scratch, temporary
from irspan.operators.vectors import Encoder


@dataclass(frozen=True)
class EmbeddingStore:
    """Embeddings of one model with its ``settings`` under ``folder``."""

    spark: SparkSession
    folder: str
    settings: dict

    @property
    def path(self) -> str:
        key = "-".join(f"{k}={self.settings[k]}" for k in sorted(self.settings))
        return f"{self.folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9=._-]', '_', key)}"

    def _manifests(self) -> list[int]:
        """Numbers of whole manifests, which are few: one an update."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("manifest-")) for f in found)

    def _tables(self) -> list[str]:
        numbers = self._manifests()
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{numbers[-1]}").first().value) if numbers else []

    def _commit(self, tables: list[str]) -> None:
        number = max(self._manifests(), default=0) + 1
        self.spark.createDataFrame([(json.dumps(tables),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{number}")

    def stored(self) -> DataFrame | None:
        """doc_id, digest, embedding and version (the number of the update that made it); None of an empty store."""
        tables = self._tables()
        return self.spark.read.parquet(*(f"{self.path}/{t}" for t in tables)) if tables else None

    def update(self, texts: DataFrame, encoder: Encoder) -> DataFrame:
        """Encode what is not there yet of ``texts`` (doc_id, text); doc_id, embedding and version of all of them."""
        rows = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        digest = F.md5(F.col("text").cast("binary"))
        before = self.stored()
        with scratch():
            new = rows.withColumn("digest", digest)
            if before is not None:
                new = new.join(before.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
            new = temporary(new.dropDuplicates(["doc_id", "digest"]), "changed")
            if before is None or new.limit(1).count():
                name = f"part-{uuid.uuid4().hex}"
                made = encoder.encode(new).select("doc_id", "digest", "embedding", F.lit(max(self._manifests(), default=0) + 1).alias("version"))
                made.write.parquet(f"{self.path}/{name}")
                self._commit([*self._tables(), name])
        wanted = rows.select("doc_id", digest.alias("digest")).distinct()
        return self.stored().join(wanted, ["doc_id", "digest"], "left_semi").select("doc_id", "embedding", "version")

    def compact(self, texts: DataFrame) -> None:
        """One table of the embeddings of ``texts`` alone; the others go."""
        before, kept = self._tables(), self.stored()
        if kept is None:
            return
        wanted = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).distinct()
        name = f"part-{uuid.uuid4().hex}"
        kept.join(wanted, ["doc_id", "digest"], "left_semi").write.parquet(f"{self.path}/{name}")
        self._commit([name])
        for t in before:
            drop(self.spark, f"{self.path}/{t}")
