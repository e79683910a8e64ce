"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components", most: int = 60) -> DataFrame:
    """links (a, b) -> node, component (the smallest node reachable), for nodes in a link to another.

    Each round hangs every node's larger neighbours on its smallest one, then
    its smaller neighbours too; the number of rounds grows with the logarithm of
    a component's size.  Sums are combined before they are moved and hot nodes'
    rows are joined from tables, so Spark can split them.  Nothing is collected.
    Labels that have not settled after ``most`` rounds are an error, never a result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = scratch.save(edges, f"{name}-0"), None
    for k in range(1, most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-{k}-large")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{name}-{k}-edges")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-small")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.save(small, f"{name}-{k}")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large", f"{name}-{k}-edges", f"{name}-{k}-small")
        edges = small
        if state[0] == 0 or tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
