"""Connected components of an edge table, by distributed large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); component is the smallest node reached.

    Each step writes its edges to the shared folder. A node's smallest neighbour is found by a sum
    that combines before the shuffle and then joined back, so a node of many edges needs no task of
    its own. Steps go on until the edges no longer change, which takes about log(nodes) of them.
    Self-links, repeated links and either direction are fine; no edges give an empty table.
    """
    e = cut(edges.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    while True:
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = (both.filter(F.col("v") > F.col("u")).join(low, "u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        # small star: smaller neighbours and the node itself are tied to the smallest
        e = cut(e)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        e = cut(e)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tied.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
