"""Connected components as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import dropped_shuffles, fewer, release, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its surroundings."""
    both = edges.select(F.explode(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))).alias("e")).select("e.*")
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("least"))
    return both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    joined = edges.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e"))
    return joined.select("e.*").filter("hi > lo").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (hi > lo); a component is named
    by its least node.

    Large-star and small-star steps alternate until nothing changes, in a number
    of rounds that grows with the logarithm of the longest chain. Every round's
    edges are settled, in as many parts as their number asks for, so that few
    edges need no shuffle; only their count and hash sum reach the driver.
    """
    now = settle(edges.distinct())
    seen = None
    while True:
        with dropped_shuffles(now.sparkSession):
            count, total = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if count == 0 or (count, total) == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = count, total
        # A step makes at most two edges of one.
        then = settle(fewer(_small_star(_large_star(fewer(now, count))), 2 * count))
        release(now)
        now = then
