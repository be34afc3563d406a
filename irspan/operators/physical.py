"""Physical choices that no result depends on: spreading small inputs, cutting lineage, checked broadcasts,
numbering rows without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An input below this estimate has too few row groups to occupy the cores, and is dealt out by a shuffle.
SPREAD_BYTES = 256 << 20
#: Rows of query terms that are broadcast; beyond, Spark joins by its own estimate.
BROADCAST_ROWS = 100_000

_folders: dict[str, str] = {}
_local: list[str] = []


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, with the rows of a small input dealt out by ``key``; a larger one is read where it lies."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if size < SPREAD_BYTES else df


def _shared(spark: SparkSession) -> str:
    """A folder of this application in the one that ``spark.checkpoint.dir`` names.

    The file system of the driver's JVM is told to delete it on exit, which also happens when the session has been
    stopped before.  Only a local master may do without the setting, as in tests: a cluster's executors do
    not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        if base is None:
            base = tempfile.mkdtemp(prefix="irspan-")
            _local.append(base)
        path = f"{base.rstrip('/')}/irspan-{app}-{uuid.uuid4().hex}"
        where, files = _files(spark, path)
        files.mkdirs(where)  # only what is there can be marked
        files.deleteOnExit(where)
        _folders[app] = path
    return _folders[app]


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A path in the application's shared folder that nothing has yet; it goes when the driver ends."""
    return f"{_shared(spark)}/{kind}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder whose rows are no longer needed."""
    where, files = _files(spark, path)
    files.delete(where, True)


@atexit.register
def _clean() -> None:
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is :func:`temporary` inside goes at the end: it must have been read by then.  Inner ones leave it to
    the outermost."""
    _open.append([])
    try:
        yield
    finally:
        made = _open.pop()
        if _open:
            _open[-1].extend(made)
        else:
            for spark, path in made:
                drop(spark, path)


def temporary(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as :func:`written`, until the end of the :func:`scratch` around; without one, of the driver."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    if _open:
        _open[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows``, its size, is within :data:`BROADCAST_ROWS`."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def cumulative(df: DataFrame, order: list[str], weight: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the running sum of an integer ``weight`` in the order of columns that no two rows share.

    Rows are dealt out by ranges of ``order``; the sum of each range (one number a partition) goes to the
    driver, and a row's value is that of the ranges before its own plus its place there.  So no task
    holds more than a range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, own = f"{name}_part", f"{name}_own"
    ranged = df.withColumn(own, weight.cast("long")).repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "ranges")  # ranges are sampled: they must not be drawn again
    sums = dict(ranged.groupBy(part).agg(F.sum(own)).collect())  # a row a partition
    before, offsets = 0, []
    for p in sorted(sums):
        offsets.append((p, before))
        before += sums[p] or 0
    offset = spark.createDataFrame(offsets, f"{part} int, {name}_before long")
    within = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, within).join(F.broadcast(offset), part).withColumn(name, F.col(name) + F.col(f"{name}_before")).select(*df.columns, name)


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the rank of ``column``; equal values share the mean of their ranks.

    Values are counted first, so a frequent one is a single row when ranks are made.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = cumulative(counts, ["value"], F.col("n"), "upto").select(F.col("value").alias(column), (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name))
    return df.join(ranked, column)
