"""T-1: the live evaluation summary as a Structured Streaming query.

Result files (JSON lines) arriving in a folder are read with an explicit
schema; the A-9 aggregation runs as a stateful streaming group-by
(`complete` output: the summary is small, one row per model x task), with
the state and offsets in a checkpoint under the shared folder so a restart
or lost executor resumes instead of recounting.  `availableNow` processes
everything present (in several micro-batches when `max_files` is set) and
stops, which is what a periodic refresh needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from roomlens.operators.evaluate import summarize_records


def summary_stream(spark: SparkSession, source_dir: str, schema: StructType, checkpoint_dir: str,
                   query_name: str, max_files: int | None = None) -> DataFrame:
    """All files that are there, by default in one micro-batch, so that the
    number of batches does not grow with the data."""
    reader = spark.readStream.schema(schema)
    records = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(source_dir)
    summary = summarize_records(records)
    q = (summary.writeStream.outputMode("complete").format("memory").queryName(query_name)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(query_name)


def live_summary(spark: SparkSession, source_dir: str, schema: StructType, checkpoint_dir: str,
                 query_name: str, every_seconds: int = 5, max_files: int = 100) -> StreamingQuery:
    """T-1 as the reference runs it: the summary refreshed every
    `every_seconds`.  Returns the running query; `spark.table(query_name)`
    holds the latest complete summary, and the checkpoint lets a restarted
    query continue from its state."""
    records = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
               .json(source_dir))
    return (summarize_records(records).writeStream.outputMode("complete").format("memory")
            .queryName(query_name).option("checkpointLocation", checkpoint_dir)
            .trigger(processingTime=f"{every_seconds} seconds").start())
