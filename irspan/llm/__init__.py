"""Training-data operators: fingerprints, extraction, tokenising, dedup, filtering, packing, archives.

Nothing else in the library imports this subpackage; each module holds one operator and the
query that applies it.  ``queries()`` and ``oracle_sql()`` collect what ``__spark_entry__`` registers.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "lz_fingerprint",
    "html_extract",
    "byte_bpe",
    "simhash_dedup",
    "language_id",
    "line_quality",
    "pattern_packing",
    "suffix_dedup",
    "warc",
    "knn_quality",
    "source_divergence",
    "line_dedup",
    "embedding_whitening",
)


def queries() -> dict:
    """Name to callable(spark, sf_dir) of every query of this subpackage."""
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    """DuckDB SQL for those queries that SQL can express."""
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__name__}.{m}"), "ORACLES", {}).items()}
