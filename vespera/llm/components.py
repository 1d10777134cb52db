"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import drop_stored, spread_join, stored


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """large: every neighbour above u goes to u's least neighbour; small: every neighbour below u does, and u.

    A node of many links is dealt over tasks (total: how many links there are at most).
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = least.select("a", F.least("a", "m").alias("m"), "n")
    to = spread_join(both, least, "a", 2 * total)
    if large:
        out = to.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = to.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Gives node, component (least node of it) for every node that has a link; always a table on disk."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    state, total = None, edges.count()
    while True:
        # a star step never makes more links than it is given and one a node
        after = stored(_star(_star(edges, True, total), False, 2 * total), "stars")
        got = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(edges)
        edges = after
        if (got["n"], got["h"]) == state:
            break
        state, total = (got["n"], got["h"]), got["n"]
    least = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
