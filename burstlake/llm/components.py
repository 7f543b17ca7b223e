"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of edges (u, v) of longs: the smallest node it is linked to over any path.

    Large and small stars by turns: each round hangs nodes on the smallest
    neighbour they know, so a star as large as the graph stays a row a node.
    Each round's edges are a table in the shared folder, and so are the nodes'
    smallest neighbours: a join then has two tables below its exchanges, whose
    partitions Spark splits where a hub's edges fill one. No edges, no rows;
    repeated edges and loops change nothing.
    """
    e = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, f"{name}-large")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        k += 1
        e = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
