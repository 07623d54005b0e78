"""Connected components of links between numbered nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import discard, stored


def _both(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the node's least neighbour (itself included)."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def near_labels(links: DataFrame) -> DataFrame:
    """(node, label): the least node within two links. Nodes of one label are connected; the converse
    need not hold. Two joins, however long the components are."""
    both = _both(links.filter("a <> b"))
    one = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    two = both.join(one.withColumnsRenamed({"a": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("label"))
    return two.withColumn("label", F.least("label", "node"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node that can be reached.

    Each round halves the distance to it at least, so rounds grow with the logarithm of a component's
    length; a hub's links are joined, never gathered. Nodes without links to others are left out.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        last, links = links, stored(_small_star(_large_star(links)).filter("a <> b").distinct())
        discard(last)
        # Done when every node has one link, to a node that has none itself.
        ends = links.select(F.col("a").alias("node"), F.lit(2).alias("n")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("n")))
        ends = ends.groupBy("node").agg(F.sum("n").alias("out"), F.min("n").alias("least"))
        if ends.filter("out > 2 OR out = 2 AND least = 0").isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
