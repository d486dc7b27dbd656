"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.session import dropped, materialised


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of an edge (a, b) of longs; component is the smallest node reachable.

    A round links every larger neighbour of a node to the smallest one around it, then every node
    and its smaller neighbours to the smallest of these; rounds end when nothing changes, with a
    star around each smallest node.  Only minima are taken of a node's neighbours, with partial
    aggregation, and joins read written tables, so a node with very many edges can be split.
    """
    e = materialised(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = print_of(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialised(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = materialised(both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lowest = materialised(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = large.join(lowest.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after = materialised(small.distinct(), "edges")
        dropped(e, least, large, lowest)
        e, before, now = after, now, print_of(after)
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
