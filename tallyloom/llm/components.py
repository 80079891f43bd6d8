"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, spread_join, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long) that has an edge; root is the least node it can
    reach. Each round is a few aggregations and two joins, written out, so a lost executor costs one round;
    the end is seen from a count and a checksum. A node to which a good part of all edges lead is salted in the
    joins, so a star is not one task. An empty table gives an empty result."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours move to the least of the neighbourhood.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).filter("n > 0"), "least")
        larger = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = written(spread_join(larger, least, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star")
        # Small star: a node's smaller neighbours and itself move to the least of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        met = spread_join(large, low, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = written(met.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, least, large, low)
        now = small
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
