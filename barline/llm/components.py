"""Connected components by alternating star contractions over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.session import written

ROUNDS = 60  # contraction needs O(log^2 n) rounds; reaching this bound is an error, never a silent end


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones, and writes the links to the
    shared folder. A node's neighbours are never gathered: the smallest is an aggregate that is joined back, and a hub's rows
    are split by the adaptive skew join. Self-links and nulls are ignored.
    """
    edges = written(_tidy(links), "links")
    last = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # a > b now: the smaller neighbours of a node
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(_tidy(small), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
            return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
        last = state
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _tidy(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
