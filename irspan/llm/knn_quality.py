"""Quality of a text by a vote of its nearest labelled neighbours.

The terms of a text are its four-character strings, case folded, and as many of their shapes (letters
by case, digits, white space, each punctuation mark as itself), hashed into :data:`TERMS` slots each,
and its repeated three-word windows.  Learning takes a bounded sample of labelled rows, weighs
square-rooted shares of terms by inverse document frequency and finds a latent-semantic space of
:data:`RANK` dimensions by a randomised singular value decomposition.  The sample's vectors are
broadcast; every document is projected and compared with all of them in blocks of exact cosine
products, and the labels of its :data:`NEIGHBOURS` nearest are averaged by a power of the cosine.

Defined cases: a null or empty text scores 0; without labelled rows every score is 0.  A document
labelled twice counts once, by its lower label, and of several texts under one id one is learned from
(that of the least hash); labels other than 0 and 1, and null ones, are left out.
Among equal cosines (to :data:`DECIMALS` decimals) the reference with the lower id comes first.  Rows
that repeat get the same score.  A very long text is scored whole, :data:`PART` characters at a time.
An empty table gives no rows.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

#: At most about so many labelled rows of either class are learned from, picked by a hash of the id.
SAMPLE_ROWS = 2_000
#: Slots of either kind of terms, dimensions, neighbours that vote, and the power of their cosines.
TERMS, RANK, NEIGHBOURS, POWER = 4096, 64, 25, 8
#: What shapes, and one repeated window, count for, against one string of characters.
SHAPE_WEIGHT, REPEAT_WEIGHT = 2, 4
#: Documents, and characters of them, that are looked at together.
BLOCK_DOCS, PART = 128, 1 << 18
DECIMALS = 9


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its lower-case letter (one space for all white space), and its shape: 40 of them."""
    folded, shape = np.arange(0x110000, dtype=np.uint32), np.full(0x110000, 39, np.uint32)
    for i in range(0x30000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            folded[i] = ord(low) if len(low) == 1 else i
            shape[i] = 1 if c.islower() else 2 if c.isupper() else 3
        elif c.isdigit():
            shape[i] = 4
        elif c.isspace():
            folded[i] = 32
            shape[i] = 6 if c == "\n" else 5
    marks = [i for i in range(33, 127) if not chr(i).isalnum()]
    shape[marks] = np.arange(7, 7 + len(marks))
    return folded, shape


def _slots(points: np.ndarray, base: int) -> np.ndarray:
    """Slots of the strings of four that start at each place (behind the end there are zeros)."""
    padded = np.zeros(len(points) + 3, np.uint32)
    padded[: len(points)] = points
    n, k = len(points), np.uint32(base)
    code = ((padded[:n] * k + padded[1 : n + 1]) * k + padded[2 : n + 2]) * k + padded[3 : n + 3]
    return (code * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(TERMS)


def _counts(texts: list[str]) -> np.ndarray:
    """Counts of terms, one row for each text: strings, shapes, then repetition in a slot of its own."""
    out = np.zeros((len(texts), 2 * TERMS + 1), np.float32)
    ended = (t + "\0\0\0" for t in texts)  # the strings at its end are a text's own
    parts = [(i, t[at : at + PART], e[at : at + PART + 3]) for i, (t, e) in enumerate(zip(texts, ended, strict=True)) for at in range(0, len(t), PART)]
    at = 0
    while at < len(parts):  # runs of parts of about PART characters
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop][2]) <= PART):
            size += len(parts[stop][2])
            stop += 1
        run = parts[at:stop]
        lengths = np.array([len(whole) for _, _, whole in run], np.int64)
        points = np.frombuffer("".join(whole for _, _, whole in run).encode("utf-32-le", "replace"), np.uint32)
        wanted = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat([len(t) for _, t, _ in run], lengths)
        doc = np.repeat([i for i, _, _ in run], lengths)[wanted]
        first = doc[0] if len(doc) else 0
        rows = int(doc[-1]) - first + 1 if len(doc) else 0
        for j, table in enumerate(_classes()):
            slot = _slots(table[points], 0x10001 if j == 0 else 40)[wanted]
            found = np.bincount((doc - first) * TERMS + slot, minlength=rows * TERMS).reshape(rows, TERMS)
            out[first : first + rows, j * TERMS : (j + 1) * TERMS] += found
        at = stop
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """Square-rooted shares of terms, one row for each text; the last slot is for repetition."""
    texts = [t or "" for t in texts]
    out = _counts(texts)
    out[:, TERMS : 2 * TERMS] *= SHAPE_WEIGHT
    for i, t in enumerate(texts):
        words = t.split()
        if len(words) > 3:
            windows = list(map(hash, zip(words, words[1:], words[2:], strict=False)))
            out[i, -1] = REPEAT_WEIGHT * (len(windows) - len(set(windows)))
    sums = out.sum(axis=1, keepdims=True, dtype=np.float64)
    return np.sqrt(out / np.maximum(sums, 1)).astype(np.float32)


@dataclass
class Model:
    """Projection from terms to the latent space, and the labelled unit vectors in it."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def _project(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts).astype(np.float64) @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK_DOCS):
            block = texts[at : at + BLOCK_DOCS]
            votes = vote(np.round(self._project(block) @ self.vectors.T, DECIMALS), self.labels)
            out[at : at + BLOCK_DOCS] = np.where([bool(t) for t in block], votes, 0)
        return out


def vote(cosines: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Mean label of the nearest references of each row, by a power of the cosine; of equal cosines at
    the cut those of lower place count."""
    k = min(neighbours, len(labels))
    cut = np.partition(cosines, len(labels) - k, axis=1)[:, len(labels) - k, None]
    above, tied = cosines > cut, cosines == cut
    chosen = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True))
    weights = np.where(chosen, np.maximum(cosines, 0), 0) ** POWER
    return np.clip((weights @ labels) / np.maximum(weights.sum(axis=1), 1e-12), 0, 1)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``labels`` whose documents are in ``docs``; see the module's text."""
    rows = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0)
    for x, n in sizes.items():
        limit = F.when(F.col("label") == x, int(min(1.0, sample_rows / n) * (1 << 30))).otherwise(limit)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limit)  # bounded by sample_rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(2).to_pylist())
        at = [np.flatnonzero(r).astype(np.int32) for r in x]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], ["id", "label", "at", "value"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(picked), "id")
    texts = texts.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one of each id
    sample = common.map_arrow(texts, run, "id long, label int, at binary, value binary").toArrow().sort_by("id")
    width = 2 * TERMS + 1
    x = np.zeros((sample.num_rows, width), np.float32)
    for i, (at, value) in enumerate(zip(sample.column(2), sample.column(3), strict=True)):
        x[i, np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(value.as_buffer(), np.float32)
    y = sample.column(1).to_numpy().astype(np.float64)
    del sample
    if not len(x):
        return Model(np.zeros((width, 1)), np.zeros((0, 1)), y)
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
    x *= idf
    random = np.random.default_rng(7)
    basis = np.linalg.qr(x @ random.standard_normal((width, min(RANK + 16, len(x))), np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(x @ np.linalg.qr(x.T @ basis)[0])[0]
    right = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:RANK].T.astype(np.float64)
    vectors = np.concatenate([x[at : at + BLOCK_DOCS].astype(np.float64) @ right for at in range(0, len(x), BLOCK_DOCS)])
    return Model(idf[:, None] * right, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), y)


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``score``; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * SAMPLE_ROWS vectors at most
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    k = len(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = held.value.score(batch.column(k).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(scores)], [*(f"k{i}" for i in range(k)), "score"])

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_column).alias("text"))
    out = common.map_arrow(rows, run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "score double"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "score")


def accepted(docs: DataFrame, model: Model, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with at least that score; all of them where nothing was learned."""
    if not len(model.labels):
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    return common.filter_arrow(docs, lambda texts: (held.value.score(texts) >= least).tolist(), text_column)


#: Documents whose crc32 leaves this remainder by FOLDS are held out.
FOLDS, HELD_OUT = 3, 1


def is_held_out(id_column: str = "doc_id"):
    return F.coalesce(common.crc32_of(id_column) % FOLDS == HELD_OUT, F.lit(False))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labelled rows that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels").where(~is_held_out()))
    return predict(common.spread(docs), model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_knn_quality": op10_knn_quality}
