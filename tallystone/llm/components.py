"""Connected components of an edge table by alternating star contraction.

Large-star hangs the larger neighbours of a node on its smallest neighbour, small-star the smaller
ones; both keep connectivity and every round shortens the trees, so that the edges end as stars
whose centre is the smallest node. Each round is a grouped minimum (combined before the shuffle)
and a join; rounds are stored in the shared folder, nothing passes through the driver but a count
and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node a to the smaller node b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge but roots; `edges` has long columns a and b."""
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(now)
    while True:
        after = materialize(_small_star(_large_star(now)), "edges")
        new = _mark(after)
        if new == mark:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, mark = after, new


def _mark(edges: DataFrame) -> tuple:
    """A count and a sum of hashes: equal edge sets, equal marks."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())
