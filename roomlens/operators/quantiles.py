"""Exact order statistics per group without a per-group task.

``percentile``/``median`` aggregates keep every distinct value of a group in
one aggregation buffer; ``row_number`` over a group window sorts the whole
group in one task.  Here equal values are counted first, with a map-side
combine, so a value that fills most of a group is one row.  The distinct
values are range-partitioned on (group, value) and get the range of ranks
they cover from running sums: inside a partition, and over one row per
(partition, group).  Each statistic then joins the value whose ranks hold its
target; there are at most two targets per statistic and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import ensure_checkpoint_dir


def value_ranks(df: DataFrame, group_cols: list[str], value_col: str) -> tuple[DataFrame, DataFrame]:
    """((group..., _v, _from, _to), (group..., _n)): each distinct non-NULL
    value with the 0-based ranks [_from, _to) it covers in its group, and the
    number of values per group (0 where all are NULL)."""
    ensure_checkpoint_dir(df.sparkSession)
    counted = df.groupBy(*group_cols, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).checkpoint()
    sizes = counted.groupBy(*group_cols).agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("_n"))
    vals = counted.where(F.col("_v").isNotNull()).repartitionByRange(*group_cols, "_v") \
        .withColumn("_pid", F.spark_partition_id()).checkpoint()
    per = vals.groupBy("_pid", *group_cols).agg(F.sum("_c").alias("_s"))
    before = Window.partitionBy(*group_cols).orderBy("_pid")
    per = per.select("_pid", *group_cols, (F.sum("_s").over(before) - F.col("_s")).alias("_base"))
    inside = Window.partitionBy("_pid", *group_cols).orderBy("_v")
    upto = vals.withColumn("_to", F.sum("_c").over(inside)).join(per, ["_pid", *group_cols])
    return upto.select(*group_cols, "_v", (F.col("_base") + F.col("_to") - F.col("_c")).alias("_from"),
                       (F.col("_base") + F.col("_to")).alias("_to")), sizes


def order_statistics(df: DataFrame, group_cols: list[str], value_col: str,
                     linear: dict[str, float] | None = None,
                     nearest_rank: dict[str, float] | None = None) -> DataFrame:
    """One row per group with the requested statistics and ``n``, the number
    of values; a group without values has NULL statistics and n = 0.

    linear:       name -> p, linear interpolation at rank p*(n-1)
                  (numpy default; p=0.5 is the median of an even count).
    nearest_rank: name -> p, the value at rank max(ceil(p*n)-1, 0).
    """
    r, sizes = value_ranks(df, group_cols, value_col)
    targets = []
    for name, p in (linear or {}).items():
        pos = F.lit(p) * (F.col("_n") - 1)
        targets.append(F.struct(F.lit(name).alias("stat"), F.floor(pos).cast("long").alias("pos"),
                                (pos - F.floor(pos)).alias("w"), F.lit(0.0).alias("pad")))
        targets.append(F.struct(F.lit(name).alias("stat"), F.ceil(pos).cast("long").alias("pos"),
                                F.lit(None).cast("double").alias("w"), F.lit(1.0).alias("pad")))
    for name, p in (nearest_rank or {}).items():
        # ceil(p*n) - 1 computed on the decimal p so 0.95*20 is exactly 19
        pos = F.greatest(F.ceil(F.lit(p).cast("decimal(10,6)") * F.col("_n")) - 1, F.lit(0))
        targets.append(F.struct(F.lit(name).alias("stat"), pos.cast("long").alias("pos"),
                                F.lit(None).cast("double").alias("w"), F.lit(-1.0).alias("pad")))
    # at most 2 rows per statistic per group: broadcast behind its measured size
    t = broadcast_if_small(sizes.where("_n > 0").select(*group_cols, F.explode(F.array(*targets)).alias("t"))
                           .select(*group_cols, "t.*"))
    hit = r.join(t, group_cols).where((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to")))
    # lower (pad 0, carries weight w) and upper (pad 1) rows of each linear stat
    lo = F.max(F.when(F.col("pad") == 0, F.col("_v")))
    hi = F.max(F.when(F.col("pad") == 1, F.col("_v")))
    w = F.max(F.when(F.col("pad") == 0, F.col("w")))
    nr = F.max(F.when(F.col("pad") == -1, F.col("_v")))
    per = hit.groupBy(*group_cols, "stat").agg(
        F.coalesce(nr, lo + (hi - lo) * w).alias("value"))
    names = list((linear or {}).keys()) + list((nearest_rank or {}).keys())
    return sizes.withColumnRenamed("_n", "n").join(
        per.groupBy(*group_cols).pivot("stat", names).agg(F.first("value")), group_cols, "left")
