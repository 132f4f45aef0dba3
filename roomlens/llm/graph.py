"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its
    smallest node.  Null ends and self links are ignored, an empty table
    gives an empty result.

    Alternating large-star and small-star rounds: each round is two
    ``min`` aggregates (combined before the shuffle, so a hub adds one row
    per task) and two equi-joins on the node, which AQE splits where a hub
    is large.  The number of rounds grows with the logarithm of the size.
    Each round ends in a reliable checkpoint."""
    ensure_checkpoint_dir(edges.sparkSession)
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = (edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
         .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct().checkpoint())
    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large: every larger neighbour points to the smallest of the star
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        # small: every smaller neighbour, and the node, point to the smallest
        e = small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) \
            .distinct().checkpoint()
    named = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return named.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
