"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, written


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id of links (a, b) the smallest id that links reach from it.

    Each round points every id to its smallest neighbour, doubles the pointers until all reach an id that points to
    itself, replaces the ends of the links by what they point to, and drops loops and repeats, until no link is left.
    A round leaves at most half of the linked ids, so the rounds, and the doublings in each, grow with the logarithm of
    the longest path. All rounds are tables in the shared folder; only counts come to the driver. An empty table
    gives an empty table."""
    edges = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "cc-edges")
    total = None
    left = edges.count()
    while left:
        n = 2 * left
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).select("id", F.least("id", "up").alias("up"))
        up = written(up, "cc-up", n)
        n = up.count()
        moved = 1
        while moved:
            jump = broadcast_if_small(up.select(F.col("id").alias("_i"), F.col("up").alias("_u")), n)
            up = up.join(jump, F.col("up") == F.col("_i")).select("id", F.col("_u").alias("up"), (F.col("_u") != F.col("up")).alias("moved"))
            up = written(up, "cc-up", n)
            moved = up.filter("moved").count()
        side = broadcast_if_small(up.select("id", "up"), n)
        a, b = (side.select(F.col("id").alias(f"_{x}"), F.col("up").alias(f"_u{x}")) for x in "ab")
        edges = edges.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
        edges = edges.select(F.greatest("_ua", "_ub").alias("a"), F.least("_ua", "_ub").alias("b")).filter("a <> b").distinct()
        edges = written(edges, "cc-edges", left)
        if total is None:
            ids = n
            total = up.select("id", F.col("up").alias("component"))
        else:
            step = side.select(F.col("id").alias("_i"), F.col("up").alias("_u"))
            total = total.join(step, F.col("component") == F.col("_i"), "left").select("id", F.coalesce("_u", "component").alias("component"))
        total = written(total, "cc-total", ids)
        left = edges.count()
    return total if total is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
