"""Connected components of a table of links, by stars that are never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftflow.session import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Join the larger neighbours of each node (large star) or its smaller ones (small star) to the least."""
    sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if large:
        sides = sides.unionByName(sides.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link, but for the roots; the root is the least node of its component.

    ``links`` has long columns ``a, b``. Each round is written, so a lost executor repeats one round at most.
    """
    links = settle(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while _open(links):
        links = settle(_star(_star(links, True), False), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _open(links: DataFrame) -> bool:
    """Whether a node has two links, or a root is itself linked to a smaller one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up")).distinct())
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("root"))
    return not counts.where("up > 1 OR (up = 1 AND root = 0)").isEmpty()
