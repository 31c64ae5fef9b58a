"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.join(least, "u").filter("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, owner: str = "query") -> DataFrame:
    """``node, component`` for every node of the undirected edges ``u, v``.

    A component is named by its least node.  Neighbours are never gathered: each step
    takes a minimum and joins it back, so a hub costs its degree in rows and no more.
    Loops and repeated edges do not matter; no edges give an empty table.
    """

    def mark(table: DataFrame) -> tuple:
        return table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()[:]

    edges = materialize(edges.filter("u <> v").distinct(), "edges", owner)
    before = mark(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "stars", owner)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
