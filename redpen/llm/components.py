"""Connected components of links by alternating large and small stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Both steps hand each node's neighbours to its smallest one, counted with
    partial aggregation; the rounds grow with the logarithm of the longest
    path. An edge table that no longer changes consists of stars.
    """
    edges = stored(_canonical(links), "edges")
    before = _mark(edges)
    while before[0]:
        edges = stored(_canonical(_small_star(_large_star(edges))), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    centers = edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return leaves.unionByName(centers).distinct()


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller node first."""
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum over them."""
    low = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(low), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours larger than a node go to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these."""
    down = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
