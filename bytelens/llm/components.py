"""Connected components of an edge table by alternating star contraction; all state in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, sweep, table


def mark(links: DataFrame) -> tuple:
    """A digest of an edge table."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`a`, `b` (any order, repeats allowed) -> node, component: the least node of each component.

    Large-star and small-star steps: every node points to the least node it knows; rounds grow with
    the logarithm of the diameter.  Nothing is collected; each round is one table.
    """
    links = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        # large star: each larger neighbour of a node points to the least node of its neighbourhood
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.distinct())
        # small star: a node and its smaller neighbours point to the least of them
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = table(small.filter("u != v").distinct())
        discard(large)
        before, after, old, links = mark(links), mark(new), links, new
        discard(old)
        sweep(links.sparkSession)
        if before == after:
            break
    return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
