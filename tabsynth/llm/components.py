"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _mark(edges: DataFrame) -> tuple:
    """Rows and an order-free digest, to see whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of ``edges`` (a, b: bigint), root being its smallest reachable
    node.  Each round is checkpointed in the shared folder; the number of rounds grows with
    the logarithm of the longest chain.  A star's hub is one join key, which adaptive skew
    handling splits; each node's minimum is aggregated before its shuffle."""
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before, mark = None, _mark(now)
    while mark != before:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        before, mark = mark, _mark(now)
    return now.select("a", F.col("b").alias("root")).union(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
