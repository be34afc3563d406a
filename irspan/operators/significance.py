"""Tests between systems over queries.

Frames of values per query are as small as a query set; resamples are rows made by the engine, so a
test is one aggregate.  Signs and shuffles come from hashes of (seed, resample, query), the same on any
engine; ``numpy_*`` give the streams of a NumPy generator instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irspan.operators.physical import average_ranks, cumulative

#: Up to so many queries all sign vectors are enumerated.
EXACT_QUERIES = 16
RESAMPLES = 10_000
#: Queries whose columns of NumPy's signs one task draws, signs that it holds, and shuffles between states.
BLOCK_QUERIES, BLOCK_SIGNS, STATE_EVERY = 4096, 1 << 20, 500


def aligned(a: DataFrame, b: DataFrame, validate: bool = True) -> DataFrame:
    """query_id, a, b from two frames of query_id and value; other than the same queries is an error
    when the rows are read."""
    left = a.select("query_id", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    right = b.select("query_id", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    if not validate:
        return left.join(right, "query_id").select("query_id", "a", "b")
    both = left.join(right, "query_id", "full_outer")
    lost = F.col("in_a").isNull() | F.col("in_b").isNull()
    checked = F.when(lost, F.raise_error(F.concat(F.lit("only one system has query "), "query_id"))).otherwise(F.col("query_id"))
    return both.select(checked.alias("query_id"), "a", "b")


def _tolerance(observed: Column) -> Column:
    return F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs(observed))


def paired_exact(pairs: DataFrame) -> DataFrame:
    """Two-sided p over all sign vectors; one row."""
    one = Window.orderBy("query_id")  # EXACT_QUERIES at most
    d = pairs.select("query_id", (F.col("a") - F.col("b")).alias("d")).withColumn("i", F.row_number().over(one) - 1)
    packed = d.agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("ds"), F.sum("d").alias("observed"), F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("ties"))
    masks = packed.select("*", F.explode(F.expr("sequence(0L, shiftleft(1L, cast(n as int)) - 1)")).alias("m"))
    signed = F.expr("aggregate(ds, 0D, (s, x) -> s + x.d * (1 - 2 * (shiftright(m, x.i) & 1)))")
    hits = masks.withColumn("s", signed).groupBy("observed", "n", "ties").agg(F.count_if(F.abs("s") + _tolerance(F.col("observed")) >= F.abs("observed")).alias("c"), F.count("*").alias("assignments"))
    return hits.select((F.col("observed") / F.col("n")).alias("delta"), (F.col("c") / F.col("assignments")).alias("p_value"), "n", F.lit("exact").alias("method"), "assignments", F.lit(None).cast("long").alias("seed"), "ties", (F.col("n") - F.col("ties")).alias("effective_queries"))


def paired_sampled(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Two-sided Monte-Carlo p, ``(c + 1) / (R + 1)``; signs from md5 of seed, resample and query."""
    d = pairs.select("query_id", (F.col("a") - F.col("b")).alias("d"))
    whole = d.agg(F.sum("d").alias("observed"), F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("ties"))
    draws = d.select("query_id", "d", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    nibble = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), "query_id").cast("binary")), 1, 1), 16, 10).cast("int")
    sums = draws.withColumn("s", F.when(nibble < 8, F.col("d")).otherwise(-F.col("d"))).groupBy("r").agg(F.sum("s").alias("s"))
    hits = sums.crossJoin(whole).groupBy("observed", "n", "ties").agg(F.count_if(F.abs("s") + _tolerance(F.col("observed")) >= F.abs("observed")).alias("c"))
    return hits.select((F.col("observed") / F.col("n")).alias("delta"), F.least(F.lit(1.0), (F.col("c") + 1) / F.lit(resamples + 1.0)).alias("p_value"), "n", F.lit("monte-carlo").alias("method"), F.lit(resamples).cast("long").alias("assignments"), F.lit(seed).cast("long").alias("seed"), "ties", (F.col("n") - F.col("ties")).alias("effective_queries"))


def paired_test(a: DataFrame, b: DataFrame, resamples: int = RESAMPLES, seed: int = 0, exact_queries: int = EXACT_QUERIES) -> DataFrame:
    """Paired randomisation test of two systems' values (query_id, value): exact for few queries."""
    pairs = aligned(a, b)
    return paired_exact(pairs) if pairs.count() <= exact_queries else paired_sampled(pairs, resamples, seed)


def stream_signs(seed: int, start: int, count: int) -> np.ndarray:
    """Elements ``start`` to ``start + count`` of NumPy's ``default_rng(seed).choice([-1, 1], size)``, read flat.

    The generator gives 64 bits at a time and a choice of two takes the top bit of each half, the lower half first;
    so any element is one jump away, and no other has to be drawn before it.
    """
    bits = np.random.PCG64(seed).advance(start // 2)
    raw = bits.random_raw((start % 2 + count + 1) // 2)
    both = np.stack([raw >> np.uint64(31), raw >> np.uint64(63)], axis=1) & np.uint64(1)
    return both.ravel()[start % 2 : start % 2 + count].astype(np.float64) * 2 - 1


def numpy_paired_test(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Two-sided Monte-Carlo p with the signs of NumPy's generator, queries in the order of their ids; one row.

    The matrix of signs (resamples by queries) is never whole: queries are dealt into blocks, whose task draws
    its columns of every row and sends on one partial sum a resample.
    """
    d = pairs.select("query_id", (F.col("a") - F.col("b")).alias("d"))
    whole = d.agg(F.sum("d").alias("observed"), F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("ties"))
    n = pairs.count()
    placed = cumulative(d, ["query_id"], F.lit(1), "nth").select((F.col("nth") - 1).alias("at"), "d", F.floor((F.col("nth") - 1) / BLOCK_QUERIES).alias("block"))

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        first, values = block.column("at")[0].as_py(), block.column("d").to_numpy()
        step = max(1, BLOCK_SIGNS // max(n, 1)) if len(values) == n else 1
        sums = np.empty(resamples)
        for r in range(0, resamples, step):  # whole rows lie together; columns of one block don't
            rows = min(step, resamples - r)
            sums[r : r + rows] = stream_signs(seed, r * n + first, rows * len(values)).reshape(rows, -1) @ values
        return pa.table([pa.array(np.arange(resamples, dtype=np.int64)), pa.array(sums)], ["r", "s"])

    sums = placed.groupBy("block").applyInArrow(run, "r long, s double").groupBy("r").agg(F.sum("s").alias("s"))
    hits = sums.crossJoin(F.broadcast(whole)).groupBy("observed", "n", "ties").agg(F.count_if(F.abs("s") + _tolerance(F.col("observed")) >= F.abs("observed")).alias("c"))  # one row
    return hits.select((F.col("observed") / F.col("n")).alias("delta"), F.least(F.lit(1.0), (F.col("c") + 1) / F.lit(resamples + 1.0)).alias("p_value"), "n", F.lit("monte-carlo, numpy").alias("method"), F.lit(resamples).cast("long").alias("assignments"), F.lit(seed).cast("long").alias("seed"), "ties", (F.col("n") - F.col("ties")).alias("effective_queries"))


def numpy_correlation_test(pairs: DataFrame, permutations: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Two-sided permutation p of the rank correlation of x and y by query_id with the shuffles of NumPy's
    generator, queries in the order of their ids; a constant gives (0, 1).

    A shuffle takes as many numbers as it happens to need, so the stream can't be jumped: the driver only runs
    it ahead and keeps its state every :data:`STATE_EVERY` shuffles; tasks begin there and make the products.
    The ranks, 16 bytes a query, go to the tasks.
    """
    spark = pairs.sparkSession
    ranks = average_ranks(average_ranks(pairs.select("query_id", "x", "y"), "x", "rx"), "y", "ry")
    table = ranks.select("query_id", "rx", "ry").toArrow().sort_by("query_id")  # a query set
    x, y = (table.column(c).to_numpy() for c in ("rx", "ry"))
    x, y = x - x.mean() if len(x) else x, y - y.mean() if len(y) else y
    n, scale = len(x), float(np.sqrt((x @ x) * (y @ y)))
    if not scale:
        return spark.createDataFrame([(0.0, 1.0, n)], "rho double, p_value double, n long")
    enough = abs(float(x @ y)) / scale - 1e-12
    rng, places, states = np.random.default_rng(seed), np.arange(n, dtype=np.float64), []
    for i in range(permutations):
        if i % STATE_EVERY == 0:
            states.append((rng.bit_generator.state, min(STATE_EVERY, permutations - i)))
        rng.permutation(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for i in batch.column(0).to_pylist():
                own = np.random.default_rng()
                own.bit_generator.state, shuffles = states[i]
                hits.append(sum(abs(float(x @ own.permutation(y))) / scale >= enough for _ in range(shuffles)))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], ["hits"])

    counted = spark.range(len(states)).repartition(len(states), "id").mapInArrow(run, "hits long").agg(F.sum("hits").alias("c"))
    return counted.select(F.lit(float(x @ y) / scale).alias("rho"), ((F.col("c") + 1) / F.lit(permutations + 1.0)).alias("p_value"), F.lit(n).cast("long").alias("n"))


def holm(p_values: DataFrame, validate: bool = True) -> DataFrame:
    """position and p with ``adjusted``: Holm's step-down values, at most 1."""
    if validate:
        good = F.coalesce(F.col("p").between(0, 1) & ~F.isnan("p"), F.lit(False))
        n, bad = p_values.agg(F.count("*"), F.count_if(~good)).first()
        if not n or bad:
            raise ValueError("there must be p-values, all between 0 and 1")
    order = Window.orderBy("p", "position")  # one family of tests
    stepped = p_values.withColumn("nth", F.row_number().over(order)).withColumn("step", (F.count("*").over(Window.partitionBy()) - F.col("nth") + 1) * F.col("p"))
    return stepped.select("position", "p", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation of x and y; 0 where either is constant.  One row: rho and n.

    Ranks come from ranges of values (:func:`physical.average_ranks`), so frames of any size will do.
    """
    ranks = average_ranks(average_ranks(pairs.select("x", "y"), "x", "rx"), "y", "ry")
    return ranks.agg(F.count("*").alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy")).select(_rho().alias("rho"), "n")


def _rho() -> Column:
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    return F.when(var <= 0, 0.0).otherwise(F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))))


def correlation_test(pairs: DataFrame, permutations: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Two-sided permutation p of the rank correlation of x and y by query_id; a constant gives (0, 1)."""
    ranks = average_ranks(average_ranks(pairs.select("query_id", "x", "y"), "x", "rx"), "y", "ry")
    ranks = cumulative(ranks, ["query_id"], F.lit(1), "i").select("query_id", "rx", "ry", "i")
    whole = ranks.agg(F.count("*").alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    draws = ranks.select("query_id", "ry", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("r"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), "query_id").cast("binary"))
    shuffled = draws.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy(key, "query_id")))
    sums = shuffled.join(ranks.select("i", "rx"), "i").groupBy("r").agg(F.sum(F.col("rx") * F.col("ry")).alias("s"))
    centre = F.col("sx") * F.col("sy") / F.col("n")
    hits = sums.crossJoin(whole).groupBy("n", "sx", "sy", "sxy", "sxx", "syy").agg(F.count_if(F.abs(F.col("s") - centre) + 1e-9 >= F.abs(F.col("sxy") - centre)).alias("c"))
    rho = _rho()
    constant = (F.col("n") * F.col("sxx") <= F.col("sx") * F.col("sx")) | (F.col("n") * F.col("syy") <= F.col("sy") * F.col("sy"))
    return hits.select(rho.alias("rho"), F.when(constant, 1.0).otherwise((F.col("c") + 1) / F.lit(permutations + 1.0)).alias("p_value"), "n")


def terciles(rows: DataFrame) -> DataFrame:
    """Three near-equal groups by predictor (query_id, predictor, advantage), earlier ones the larger:
    size, range, mean advantage."""
    placed = cumulative(rows, ["predictor", "query_id"], F.lit(1), "nth")
    n = rows.count()
    size, more = divmod(n, 3)
    first, second = size + (more > 0), 2 * size + more
    tercile = F.when(F.col("nth") <= first, 1).when(F.col("nth") <= second, 2).otherwise(3)
    return placed.withColumn("tercile", tercile).groupBy("tercile").agg(F.count("*").alias("n"), F.min("predictor").alias("low"), F.max("predictor").alias("high"), F.avg("advantage").alias("mean_advantage"))


def family_summary(tests: DataFrame) -> DataFrame:
    """Of several analyses (rho, p): whether all rho are positive, significant ones, range and median.
    Where a column predictor is there, other than one predictor is an error."""
    if "predictor" in tests.columns:
        names = sorted(str(r[0]) for r in tests.select("predictor").distinct().limit(2).collect())
        if len(names) > 1:
            raise ValueError(f"the analyses are of different predictors: {', '.join(names)}")
    return tests.agg(F.bool_and(F.col("rho") > 0).alias("all_positive"), F.count_if(F.col("p") < 0.05).alias("significant"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho"), F.percentile("rho", F.lit(0.5)).alias("median_rho"))


def compare_family(systems: dict[str, DataFrame], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Every pair of systems' values (query_id, value): first, second, delta, p_value and Holm's adjusted
    value (the p-value itself for one pair)."""
    rows = []
    for i, (x, y) in enumerate(combinations(systems, 2)):
        test = paired_sampled(aligned(systems[x], systems[y]), resamples, seed)
        rows.append(test.select(F.lit(i).alias("position"), F.lit(x).alias("first"), F.lit(y).alias("second"), "delta", F.col("p_value").alias("p")))
    tests = reduce(DataFrame.unionByName, rows)
    return tests.join(holm(tests.select("position", "p"), validate=False).select("position", "adjusted"), "position").select("first", "second", "delta", F.col("p").alias("p_value"), "adjusted")


#: The predictor that is tested by itself, and those that are corrected among themselves.
PRIMARY, SECONDARY = "max_idf", ("mean_idf", "num_terms", "out_of_vocabulary_rate")


def query_dependence(statistics: DataFrame, advantage: DataFrame, permutations: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Rank correlation of each predictor of a query with a system's advantage (query_id, advantage)."""
    pairs = statistics.join(advantage, "query_id")
    rows = [correlation_test(pairs.select("query_id", F.col(c).alias("x"), F.col("advantage").alias("y")), permutations, seed).select(F.lit(i).alias("position"), F.lit(c).alias("predictor"), "rho", F.col("p_value").alias("p")) for i, c in enumerate((PRIMARY, *SECONDARY))]
    tests = reduce(DataFrame.unionByName, rows)
    corrected = holm(tests.where("position > 0").select("position", "p"), validate=False).select("position", "adjusted")
    return tests.join(corrected, "position", "left").select("predictor", "rho", F.col("p").alias("p_value"), F.coalesce("adjusted", "p").alias("adjusted"))
