"""Connected components of an edge table, by large and small stars.

Each round replaces the edges so that neighbours hang on the least neighbour; a
round is two aggregations and joins on node ids, its result is written to the
shared folder, and the rounds end when the edges no longer change. Nothing is
collected but one count and one sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import common


def _star(both: DataFrame, large: bool) -> DataFrame:
    """both has rows (u, v) of the directions that count."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    edges = both.join(least, "u")
    if large:
        return edges.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return edges.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (u, v) that have another in their component; root is the least node."""
    now = common.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u <> v").distinct()
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        now = common.stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        state = tuple(now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
