"""Connected components by alternating large-star and small-star rounds.

Each round is two joins on node keys with pre-aggregated minima; a hub's edges may be
split over tasks by adaptive skew handling, since the other side has one row for each
node. Every round is a written table, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge that is not its component's smallest; edges join unequal, non-null values."""
    now = keep(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("u", "v"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = keep(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = keep(small.union(least.select("v", "m")).distinct(), "edges")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = tuple(seen)
