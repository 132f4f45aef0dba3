"""Dense 0-based position of each row inside its group, without a per-group task.

``row_number().over(Window.partitionBy(g).orderBy(k))`` sends every row of a
group to one task; with a hot group (one result file holding a third of all
records) that task holds a third of the data.  Instead:

1. range-partition on (group, order) -- Spark samples the key range, so a hot
   group is split across many partitions -- and sort inside each partition;
2. take each row's position inside its partition from
   ``monotonically_increasing_id`` (partition id in the upper bits);
3. one partial aggregate per (partition, group) gives row counts (hence
   per-partition running offsets) and each group's first position;
4. global position minus the group's first global position = index in group,
   applied by joining the rows to that small table on (partition, group).

The sorted input is checkpointed (reliable checkpoint under the shared
``spark.checkpoint.dir``) so the three uses see one materialisation and a
lost executor cannot re-derive a different partition layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomlens.operators.sizing import broadcast_if_small

_SHIFT = 33  # monotonically_increasing_id keeps the partition id above bit 33


def index_within_groups(df: DataFrame, group_cols: list[str], order_col: str,
                        out_col: str = "index", num_partitions: int | None = None,
                        checkpoint: bool = True) -> DataFrame:
    spark = df.sparkSession
    from roomlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    keys = [*group_cols, order_col]
    # without a number, AQE sizes the partitions
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    sorted_df = (ranged.sortWithinPartitions(*keys)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_local", F.monotonically_increasing_id()
                             - F.shiftleft(F.spark_partition_id().cast("long"), _SHIFT)))
    if checkpoint:
        sorted_df = sorted_df.checkpoint(eager=True)
    # One partial aggregate over the rows: per (partition, group) its row
    # count and first local position -- at most groups + partitions rows.
    stats = sorted_df.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"),
                                                       F.min("_local").alias("_lmin"))
    # Per-partition offsets: a window over one row per partition.
    per_pid = stats.groupBy("_pid").agg(F.sum("_n").alias("_pn"))
    offsets = per_pid.select("_pid", (F.sum("_pn").over(Window.orderBy("_pid")) - F.col("_pn")).alias("_offset"))
    if not group_cols:
        # one row per partition: bounded by the partition count chosen above
        return (sorted_df.join(F.broadcast(offsets), "_pid")
                .withColumn(out_col, (F.col("_offset") + F.col("_local")).cast("long"))
                .drop("_pid", "_local", "_offset"))
    # A group's rows are contiguous in the global order; its start is the
    # least global position over the partitions it appears in.  The shift
    # table is keyed by (partition, group) and broadcast behind a measured
    # size, so rows are never shuffled by group (a hot group would land on
    # one reducer).  Above the limit the join key still carries the
    # partition id, so no reducer gets more than one range partition.
    st = stats.join(offsets, "_pid").withColumn("_gmin", F.col("_offset") + F.col("_lmin"))
    first = st.groupBy(*group_cols).agg(F.min("_gmin").alias("_start"))
    shift = broadcast_if_small(st.join(first, group_cols)
                               .select("_pid", *group_cols, (F.col("_offset") - F.col("_start")).alias("_shift")))
    return (sorted_df.join(shift, ["_pid", *group_cols])
            .withColumn(out_col, (F.col("_local") + F.col("_shift")).cast("long"))
            .drop("_pid", "_local", "_shift"))
