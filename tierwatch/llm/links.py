"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwatch.functions.shared import scratch, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour, or to the node itself."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
    larger = both.where(F.col("low") > F.col("high")).join(least, "high")
    return larger.select(F.col("low").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def _print(links: DataFrame):
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b): the smallest node that it can reach.

    Links may repeat and run either way; a link of a node to itself says nothing. Each step only
    gathers, per node, the smallest neighbour, so a node with very many links is no bottleneck.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    with scratch(links.sparkSession) as own:
        current = stage(pairs, "links", codec="zstd")
        before = _print(current)
        while before[0]:
            with scratch(links.sparkSession) as step:
                current = step.keep(stage(_small_star(_large_star(current)), "links", codec="zstd"))
            after = _print(current)
            if after == before:
                break
            before = after
        own.keep(current)
    roots = current.select(F.col("low").alias("node")).distinct()
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
