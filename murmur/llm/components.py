"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b), both long.

    Contraction: in each round every node joins the neighbour, or itself, that comes first in an order drawn anew for
    the round, and the links between the joined nodes go on. A random order shortens even a long chain by a constant
    share of its nodes a round. Smallest neighbours are pre-aggregated before the shuffle; a node with very many links
    is only ever a splittable side of a join. Empty links give no rows. All tables are in scratch.
    """
    edges = scratch.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("draw"), c.alias("node"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(draw(F.col("b"))).alias("best"))
        joined = scratch.written(first.select(F.col("a").alias("node"), F.least("best", draw(F.col("a")))["node"].alias("into")), "joined")
        if labels is None:
            labels = joined.select("node", F.col("into").alias("label"))
        else:
            labels = scratch.written(
                labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select(labels["node"], F.coalesce("into", "label").alias("label")), "labels"
            )
        left, right = (joined.select(F.col("node").alias(x), F.col("into").alias(f"{x}_into")) for x in "ab")
        moved = edges.join(left, "a").join(right, "b").where("a_into <> b_into").select(F.least("a_into", "b_into").alias("a"), F.greatest("a_into", "b_into").alias("b"))
        edges = scratch.written(moved.distinct(), "edges")
        turn += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return scratch.written(labels.join(least, "label").select("node", F.least("node", "component").alias("component")), "components")
