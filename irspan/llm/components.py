"""Connected components of an edge list, as DataFrame iterations.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and
Beyond"): every step is an aggregate by node, which is combined before it is moved, and a join with one row
a node, so that Spark can split a hub's edges over tasks (adaptive skew join).  The number of edges does
not grow.  Each round is cut by a written table; that of the round before goes.

Defined cases: repeated pairs and pairs of a node with itself change nothing; without pairs there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irspan.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges lead from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """For pairs ``u``, ``v`` of integers: node and ``component`` (the least node reachable).

    Only nodes with an edge are returned, and those that aren't the least themselves.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = common.Table(now, "edges"), None
    while True:
        last, now = now, common.Table(_small_star(_large_star(now.rows)), "edges")
        last.drop()
        state = now.rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.rows.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
