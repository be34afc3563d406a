"""Whitening of embeddings by the principal components of their distinct vectors.

Entries become integers, so counts, sums and deviations are exact.  The fit list is each distinct vector
once, written as a table; its sums come from the tasks as one row each.  Rows are centred exactly (n x - S is an
integer, divided by n as the last step) and go to Spark MLlib's ``computeSVD`` as a distributed matrix: its
singular values, squared and divided by n, are the eigenvalues of the covariance, its right vectors the
components.  The total variance is not taken from them but from the sum of the exact deviations.  All rows
are then projected, task by task, with the components as a small constant matrix.

Defined cases: a row whose vector is null or holds a null, NaN or infinite entry is dropped, and so are
empty vectors, which have no component.  Rows that repeat give equal rows and count once in the fit; a null
``vec_id`` stays null.  A component without variance (an eigenvalue under :data:`LEAST_SHARE` of the first)
has no unit to be scaled to and is not returned; so a table with a single distinct vector, like an empty
one, gives no rows.  Equal eigenvalues may have any basis of their space.  Vectors of different lengths, and
deviations beyond a long, are errors.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

#: Components that are returned, entries' scale and shift.
COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Smallest eigenvalue, against the first, that counts as one.
LEAST_SHARE = 1e-12
#: Up to so many dimensions all components are computed, from the matrix of products; beyond, the first ones only.
FULL_DIMENSIONS = 1024
_INT64 = (1 << 63) - 1


def integer_vectors(df: DataFrame, vector_column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``x`` (longs) of the rows whose vector is whole."""
    v = F.col(vector_column).cast("array<double>")
    whole = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & (F.size(v) > 0)
    return df.where(whole).select(F.col(id_column).alias("vec_id"), F.transform(v, lambda c: F.floor(SCALE * c) + SHIFT).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors differ in length: {int(lengths.min())} to {int(lengths.max())}")
    return column.flatten().to_numpy().reshape(len(lengths), -1)


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Vectors and sums by dimension; a task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "total"])

    parts = fit.select("x").mapInArrow(run, "n long, total array<long>")
    rows = parts.select("n", F.posexplode("total").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return (rows[0].n, np.array([r.s for r in rows], np.int64)) if rows else (0, np.empty(0, np.int64))


def _raised(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as integers of 64 bits where they fit."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + int(np.abs(sums).max()) if x.size else 0
    return n * x - sums if most <= _INT64 else n * x.astype(object) - sums.astype(object)


def deviations(raised: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exactly."""
    most = max(abs(int(raised.min())), abs(int(raised.max()))) if raised.size else 0
    if raised.shape[1] * most * most <= _INT64:
        return (raised * raised).sum(1)
    out = (raised.astype(object) ** 2).sum(1)
    if max(out) > _INT64:
        raise OverflowError("a deviation is larger than a long")
    return out.astype(np.int64)


@dataclass
class Whitener:
    """Vectors of the fit, their sums, components (rows) with eigenvalues, and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float

    def whitened(self, raised: np.ndarray) -> np.ndarray:
        """Rows of n x - S on the components, over the roots of their eigenvalues."""
        return (raised.astype(np.float64) / self.n) @ (self.components.T / np.sqrt(self.eigenvalues))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, DataFrame]:
    """The whitening learned from the distinct vectors of :func:`integer_vectors`, and those vectors, written."""
    distinct = common.written(vectors.select("x").distinct(), "distinct_vectors")
    n, sums = _sums(distinct)
    none = Whitener(n, sums, np.empty((0, len(sums))), np.empty(0), 0.0)
    if n < 2:
        return none, distinct
    of_dimension = F.array(*(F.lit(int(s)) for s in sums))
    raised: Column = F.transform("x", lambda v, i: F.lit(n).cast("long") * v - F.get(of_dimension, i))
    centred = distinct.select(raised.alias("raised"))
    # n^2 times the variance of n vectors, as whole numbers
    square = F.aggregate("raised", F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    total = centred.select(square.alias("s")).agg(F.sum("s").alias("s")).first().s
    if not total:
        return none, distinct
    rows = centred.select(array_to_vector(F.transform("raised", lambda v: v.cast("double") / n)).alias("v"))
    d = len(sums)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, d)
    svd = matrix.computeSVD(d if d <= FULL_DIMENSIONS else min(components, d - 1), False, LEAST_SHARE**0.5)
    eigenvalues = svd.s.toArray() ** 2 / n
    vectors_ = svd.V.toArray().T
    k = min(components, len(eigenvalues))
    signs = np.sign(vectors_[np.arange(k), np.abs(vectors_[:k]).argmax(1)])
    return Whitener(n, sums, vectors_[:k] * signs[:, None], eigenvalues[:k], float(total) / n**3), distinct


def identity_error(model: Whitener, distinct: DataFrame) -> float:
    """Largest entry of the whitened fit's covariance minus the identity; a task sends one small matrix."""
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = model.whitened(_raised(_matrix(b.column(0)), model.n, model.sums))
                products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(products.ravel())], names=["at", "s"])

    rows = distinct.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    covariance = np.array([r.s for r in rows]).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` of every row of
    :func:`integer_vectors`; no shuffle but that of the distinct vectors."""
    model, distinct = fit(vectors, components)
    error = identity_error(model, distinct)
    k = len(model.eigenvalues)
    explained = model.eigenvalues / model.variance if k else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m or not k:
                continue
            raised = _raised(_matrix(b.column(1)), model.n, model.sums)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(np.repeat(deviations(raised), k)),
                    pa.array(model.whitened(raised).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of every whole embedding, whitened."""
    return whiten(integer_vectors(common.spread(common.table(spark, sf_dir, "embeddings"))))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
