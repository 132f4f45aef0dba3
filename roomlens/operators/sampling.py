"""L-5: seeded exact-n sample per class, with replacement for short classes.

Order inside a class is md5(seed:item), so a draw is reproducible and
independent of partitioning.  The per-class top-n uses the salted top-k
(no class gathers in one task); a short class (fewer than n items) is small
by definition, and its n draws pick rank `hash(seed:class:draw) % count`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.operators.topk import top_k


def _hash_int(c) -> F.Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def sample_per_class(items: DataFrame, class_col: str, item_col: str, n: int, seed: int) -> DataFrame:
    if n <= 0:
        raise ValueError("n per class must be > 0")
    keyed = items.select(F.col(class_col).alias("cls"), F.col(item_col).cast("string").alias("item"))
    keyed = keyed.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("item"))))
    counts = keyed.groupBy("cls").agg(F.count(F.lit(1)).alias("available"))
    ranked = top_k(keyed, "cls", ["_h", "item"], n, rank_col="rank").join(counts, "cls")
    full = ranked.where(F.col("available") >= n).select(
        "cls", F.col("rank").alias("draw"), "item", F.lit(False).alias("with_replacement"))
    short = ranked.where(F.col("available") < n)
    draws = (counts.where(F.col("available") < n)
             .select("cls", "available", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
             .withColumn("rank", F.pmod(_hash_int(F.concat_ws(":", F.lit(str(seed)), "cls",
                                                              F.col("draw").cast("string"))),
                                        F.col("available")) + 1))
    picked = draws.join(short.select("cls", "rank", "item"), ["cls", "rank"]).select(
        "cls", "draw", "item", F.lit(True).alias("with_replacement"))
    return full.unionByName(picked).withColumn("draw", F.col("draw").cast("int"))


def manifest(sample: DataFrame, seed: int, n: int) -> DataFrame:
    """S-18: one row per class with the sorted list of drawn items."""
    return sample.groupBy("cls").agg(F.sort_array(F.collect_list("item")).alias("items")) \
        .select(F.lit(seed).alias("seed"), F.lit(n).alias("n_per_class"), "cls", "items")
