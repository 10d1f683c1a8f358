"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import settle


def _mark(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable, for each node that has an edge to another.

    Every step is an aggregate and a join of the edge table with itself by node, so a hub's neighbours are never
    gathered in one row; rounds grow with the logarithm of the longest path. Nulls and loops are left out; an empty
    table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = settle(e, "edges")
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        own = low.select("a", F.col("m").alias("b"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()
        e = settle(small, "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    low = e.groupBy("a").agg(F.min("b").alias("component"))
    roots = e.select(F.col("b").alias("node")).distinct()
    return low.select(F.col("a").alias("node"), "component").unionByName(roots.join(low, roots["node"] == low["a"], "left_anti").select("node", F.col("node").alias("component")))
