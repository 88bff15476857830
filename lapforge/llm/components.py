"""Connected components of a graph given as pairs of ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm.common import salted_join, side_table


def components(links: DataFrame, high: str = "a", low: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest id that can be reached.

    Each step lets the neighbours of a node point to the smallest of them. The smallest neighbour is an aggregate that
    combines in the map tasks, and comes back to the links by a salted join, so a node with very many links is spread.
    Every step is written to the shared folder; a step needs only the written one before it.
    """
    edges = side_table(
        links.where(F.col(high) != F.col(low)).select(F.greatest(high, low).alias("a"), F.least(high, low).alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = salted_join(both.where("b > a"), smallest, ["a"]).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = side_table(large, "links")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, smallest, ["a"]).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = side_table(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
