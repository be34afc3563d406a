"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that reaches a Python worker; with whole texts a batch must stay small.
BATCH_ROWS = 1000
#: Text bytes that a worker handles at a time within a batch.
SLICE_BYTES = 1 << 19
#: An input below this estimate may lie in a single row group, and is dealt out to the cores.
SPREAD_BYTES = 64 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, with the rows of a small input dealt out to all cores; a larger one is read where it lies."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's bound of an Arrow batch to ``rows``, so that long texts do not fill a worker.

    The setting is read when a frame runs, which may be after its maker has returned; so it is only
    ever lowered, and stays.  What runs at once takes :func:`batches` instead.
    """
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows for the jobs that run inside; the setting is put back."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _shared(spark: SparkSession) -> str:
    """A folder of this application in that of ``spark.checkpoint.dir``.  The file system of the driver's JVM is
    told to delete it on exit, which also happens when the session has been stopped before.  Only a local
    master may do without the setting: all its threads are on one machine; a cluster's executors would
    not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app in _folders:
        return _folders[app]
    if base is None:
        base = tempfile.mkdtemp(prefix="irspan-")
        _local.append(base)
    path = f"{base.rstrip('/')}/irspan-{app}-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.mkdirs(where)  # only what is there can be marked
    files.deleteOnExit(where)
    _folders[app] = path
    return path


_folders: dict[str, str] = {}
_local: list[str] = []


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, kind: str) -> str:
    """URI of a new folder for files that all executors and the driver see; gone when the driver ends."""
    return f"{_shared(spark)}/{kind}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder whose rows are no longer needed."""
    where, files = _files(spark, path)
    files.delete(where, True)


@atexit.register
def _clean() -> None:
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by files in the shared folder of ``spark.checkpoint.dir``; the application's
    checkpoints, which no other one can read, go when the driver's JVM ends."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    where, files = _files(spark, context.getCheckpointDir().get())
    files.deleteOnExit(where)
    return df.checkpoint()


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` cut from its lineage as a Parquet table in the shared folder: smaller than a checkpoint."""
    return Table(df, kind).rows


class Table:
    """Rows kept as Parquet in the shared folder until they are dropped."""

    def __init__(self, df: DataFrame, kind: str):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession, kind)
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished work that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, text_column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``limit`` bytes of text each; a longer text stands alone."""
    lengths = pc.binary_length(batch.column(text_column)).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        n = n or 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def trim() -> None:
    """Give a worker's freed memory back: it may live on for tasks of another kind."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text_column: str = "text") -> DataFrame:
    """``fn`` on slices of the Arrow batches of ``df``; ``fn`` is called once for each slice."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                out = fn(part)
                if out.num_rows:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def filter_arrow(df: DataFrame, accept: Callable[[list], list], text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose text ``accept`` (a list of texts to truth values) wants; no shuffle."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(accept(part.column(at).to_pylist()), pa.bool_()))
        trim()

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` for columns beside those of ``df``, made longer where one is taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_of(column: str) -> Column:
    """crc32 of the decimal text of an integer column; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
