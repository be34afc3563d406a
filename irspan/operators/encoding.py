"""Running neural models over frames: workers that load a model once and are fed batches of like length.

A model is a plug-in (:class:`Model`): a tokenizer and a forward pass over padded ids.  A task takes rows as
Arrow batches, tokenizes and cuts them to the model's length, sorts them by length and runs as many at a time
as fit :data:`Spec.batch_tokens` padded positions, so little padding is computed and memory is bounded by
tokens, not rows.  A model is loaded once a worker process, whatever the number of its tasks.  On top are a
dense encoder (mean of positions), a token encoder for late interaction, and a scorer of pairs.

Defined cases: a null text is an empty one, which has the special positions alone; equal texts give equal vectors up to
rounding, whatever is in their batch; no rows give no rows; columns of the input go along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


class Model(Protocol):
    """A tokenizer without special tokens, ids of the special ones, and vectors of padded positions."""

    cls: int
    sep: int
    pad: int
    mask: int

    def tokenize(self, texts: list[str]) -> list[list[int]]: ...

    def forward(self, ids: np.ndarray, attended: np.ndarray) -> np.ndarray:
        """(texts, positions, width) from ids (texts, positions) and which of them may be attended to."""
        ...


@dataclass(frozen=True)
class Spec:
    """How a model is loaded (a picklable callable) and run; ``name`` tells models of one worker apart."""

    load: Callable[[], Model]
    name: str
    max_tokens: int = 512
    batch_tokens: int = 1 << 14

    def __post_init__(self) -> None:
        if self.max_tokens < 3 or self.batch_tokens < 1:
            raise ValueError("there must be room for a token between the special ones")


_loaded: dict[str, Model] = {}


def model_of(spec: Spec) -> Model:
    """The model of a worker, loaded when first asked for."""
    if spec.name not in _loaded:
        _loaded[spec.name] = spec.load()
    return _loaded[spec.name]


def budgeted(lengths: list[int], budget: int) -> Iterator[list[int]]:
    """Row numbers in batches of rising length whose padded size is within ``budget``; a longer row is alone."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if batch and lengths[i] * (len(batch) + 1) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def _padded(rows: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.full((len(rows), max(map(len, rows))), pad, np.int64)
    attended = np.zeros(ids.shape, bool)
    for i, r in enumerate(rows):
        ids[i, : len(r)], attended[i, : len(r)] = r, True
    return ids, attended


def _run(df: DataFrame, texts: Callable[[pa.RecordBatch], list], spec: Spec, ids_of: Callable, vectors_of: Callable, out: StructType) -> DataFrame:
    """``df`` through a model: ``ids_of`` (model, texts) gives each row's ids, ``vectors_of`` (model, ids, attended)
    what a batch of them becomes, a value a row; ``out`` is the schema of the columns of ``df`` and the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            if not batch.num_rows:
                continue
            model = model or model_of(spec)
            ids = ids_of(model, texts(batch))
            found: list = [None] * len(ids)
            for rows in budgeted([len(x) for x in ids], spec.batch_tokens):
                for i, value in zip(rows, vectors_of(model, [ids[i] for i in rows]), strict=True):
                    found[i] = value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _arrow(out[-1]))], names=out.names)

    return df.mapInArrow(run, out)


def _arrow(field: StructField) -> pa.DataType:
    kinds = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    if isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StructType):
        return pa.list_(pa.struct([("pos", pa.int32()), ("embedding", pa.list_(pa.float64()))]))
    return kinds[field.dataType.simpleString()]


def _column(df: DataFrame, name: str) -> Callable[[pa.RecordBatch], list]:
    at = df.columns.index(name)
    return lambda batch: [t or "" for t in batch.column(at).to_pylist()]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


@dataclass(frozen=True)
class MeanEncoder:
    """The unit mean of a text's positions: a dense :class:`~irspan.operators.vectors.Encoder`."""

    spec: Spec

    def encode(self, texts: DataFrame, text_column: str = "text") -> DataFrame:
        limit = self.spec.max_tokens

        def ids_of(model: Model, rows: list[str]) -> list[list[int]]:
            return [[model.cls, *t[: limit - 2], model.sep] for t in model.tokenize(rows)]

        def vectors_of(model: Model, rows: list[list[int]]) -> list[np.ndarray]:
            ids, attended = _padded(rows, model.pad)
            hidden = model.forward(ids, attended) * attended[:, :, None]
            return list(_unit(hidden.sum(1) / attended.sum(1)[:, None]))

        return _run(texts, _column(texts, text_column), self.spec, ids_of, vectors_of, StructType([*texts.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class LateInteractionEncoder:
    """Unit vectors of a text's positions through a projection: a
    :class:`~irspan.operators.vectors.TokenEncoder`.

    Ids are the first special token, a marker of queries or documents, the text's tokens cut to the length, and
    the last special token.  A query is filled up to ``query_tokens`` with mask tokens, which nobody attends to
    and all of which count; of a document the ids in ``skipped`` are left out.  A model without its
    projection would search badly and not fail, so a missing one is an error.
    """

    spec: Spec
    projection: np.ndarray | None
    query_marker: int
    document_marker: int
    query_tokens: int = 32
    skipped: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.projection is None or np.ndim(self.projection) != 2:
            raise ValueError("there is no projection (dimensions by width) of the model's vectors")
        if self.query_tokens < 3:
            raise ValueError("there must be room for a token between the special ones of a query")

    def encode_tokens(self, texts: DataFrame, text_column: str = "text", is_query: bool = False) -> DataFrame:
        limit = self.query_tokens if is_query else self.spec.max_tokens
        marker, projection, skipped = self.query_marker if is_query else self.document_marker, np.asarray(self.projection, float), list(self.skipped)

        def ids_of(model: Model, rows: list[str]) -> list[list[int]]:
            out = [[model.cls, marker, *t[: limit - 3], model.sep] for t in model.tokenize(rows)]
            return [r + [model.pad] * (limit - len(r)) for r in out] if is_query else out

        def vectors_of(model: Model, rows: list[list[int]]) -> list[list[dict]]:
            ids, attended = _padded(rows, model.pad)
            if is_query:
                attended &= ids != model.pad
                ids = np.where(attended, ids, model.mask)
            hidden = model.forward(ids, attended)
            if hidden.shape[-1] != projection.shape[1]:
                raise ValueError(f"the projection takes {projection.shape[1]} numbers, the model gives {hidden.shape[-1]}")
            keep = np.ones(ids.shape, bool) if is_query else attended & ~np.isin(ids, skipped)
            found = _unit(hidden @ projection.T)
            return [[{"pos": int(p), "embedding": x[p]} for p in np.flatnonzero(k)] for x, k in zip(found, keep, strict=True)]

        position = StructType([StructField("pos", IntegerType()), StructField("embedding", ArrayType(DoubleType()))])
        rows = _run(texts, _column(texts, text_column), self.spec, ids_of, vectors_of, StructType([*texts.schema.fields, StructField("positions", ArrayType(position))]))
        return rows.select(*(F.col(c) for c in texts.columns if c != text_column), F.inline("positions"))


@dataclass(frozen=True)
class PairScorer:
    """A cross-encoder: query and document as one text, the score the first number of the first position.  The
    query stays whole up to half of the length, the document is cut to what is left."""

    spec: Spec

    def score(self, pairs: DataFrame, query_column: str = "query_text", document_column: str = "document") -> DataFrame:
        """``pairs`` with ``model_score``."""
        limit, at = self.spec.max_tokens, [pairs.columns.index(c) for c in (query_column, document_column)]

        def ids_of(model: Model, rows: list[tuple[str, str]]) -> list[list[int]]:
            asked = [t[: limit // 2] for t in model.tokenize([q for q, _ in rows])]
            return [[model.cls, *q, model.sep, *d[: max(0, limit - 3 - len(q))], model.sep] for q, d in zip(asked, model.tokenize([d for _, d in rows]), strict=True)]

        def values(model: Model, rows: list[list[int]]) -> list[float]:
            return model.forward(*_padded(rows, model.pad))[:, 0, 0].tolist()

        def texts(batch: pa.RecordBatch) -> list[tuple[str, str]]:
            return [(q or "", d or "") for q, d in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]

        return _run(pairs, texts, self.spec, ids_of, values, StructType([*pairs.schema.fields, StructField("model_score", DoubleType())]))


class VocabularyFile:
    """A tokenizer file of the ``tokenizers`` library, without its special tokens: what a model's ``tokenize`` calls."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
