"""Base-table access.  Column lists are passed explicitly so the parquet
scan's ReadSchema carries only what a plan needs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from roomlens.session import package_on_workers

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    package_on_workers(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Before CPU-heavy per-row work (tokenising, regex rules): deal the rows
    out to as many partitions as `roomlens.textPartitions` asks for.  Left
    unset (as on a cluster, where a scan has splits enough), nothing is
    shuffled; a local session sets it, its inputs being single splits."""
    n = df.sparkSession.conf.get("roomlens.textPartitions", None)
    return df.repartition(int(n)) if n else df
