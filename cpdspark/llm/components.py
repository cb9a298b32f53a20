"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.lineage import cut


def _least_neighbour(links: DataFrame) -> DataFrame:
    """For every ``a``, the least of itself and its ``b``."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.filter("b > a").join(_least_neighbour(both), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; here ``b < a`` in all links."""
    least = _least_neighbour(links)
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``a, b``: for every node with a link, but not the least of its component, that least node.

    Links are pairs of whole numbers in any direction; loops and repetitions do no harm. Stars need a
    number of rounds that grows with the logarithm of the longest chain; each is kept by a reliable
    checkpoint. No node's neighbours are ever gathered in one place.
    """
    now = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut(_small_star(_large_star(now).distinct()).distinct())
    return now
