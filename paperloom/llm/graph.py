"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import forget, settle


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has a link.

    Alternates two steps until nothing changes: each node's larger neighbours are hung on its smallest neighbour, then
    each node's smaller neighbours (and itself) are. Every link stays a link within its component, the number of links
    never grows, and chains shorten by half or better, so a few rounds suffice. Each round is two grouped joins; a node
    with very many neighbours is only ever reduced to a minimum and never gathered. Loops and repeated links are harmless.
    """
    edges = settle(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        following = settle(small)
        mark = following.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # distinct links: count and hash tell them
        forget(edges)
        edges = following
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
