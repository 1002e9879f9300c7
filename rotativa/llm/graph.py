"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge that isn't itself the smallest.

    ``edges`` has columns a and b of one orderable type. Large stars and small stars take turns: every node hands its
    neighbours its smallest neighbour, until each component is one star. The number of rounds grows with the logarithm
    of its diameter. A round is written to the shared folder, so a lost executor repeats no earlier one. Hubs are
    joined, never gathered, so Spark can split them.
    """
    now = stored(oriented(edges.select("a", "b").where(F.col("a") != F.col("b"))), "edges")
    before = None
    while (state := checksum(now)) != before:
        before = state
        now = stored(small_star(large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b"))).distinct()


def smallest_names(classes: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """(node, component_id): the smallest ``name`` in the component of every class; ``roots`` comes from ``components``."""
    stars = stored(roots.union(roots.select("root", "root").distinct()), "stars")
    own = classes.select(F.col(node).alias("node"), F.col(name).alias("name"))
    named = stars.join(own, "node").groupBy("root").agg(F.min("name").alias("smallest"))
    of_node = stars.join(named, "root").select("node", "smallest")
    return own.join(of_node, "node", "left").select(F.col("node").alias(node), F.coalesce("smallest", "name").alias("component_id"))
