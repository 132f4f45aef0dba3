"""T-1 with grades: a live summary that follows grading.

In the reference a grade changes a record in place and every refresh reads
all files again.  A file stream never reads a known file again, so here a
grade is a line of its own, in a folder beside the records, and the stream
keeps what each record contributed:

* the state of (file, block of indexes) holds the records of the block and
  the last grade of each.  A new record or grade takes the record's old
  contribution back and adds the new one; a grade that comes before its
  record waits for it, one that never gets a record never counts;
* the differences, a row or two per state and batch, are added to the
  previous summary by an idempotent sink: one version per batch, under the
  batch's number.  A batch that is run again after a failure starts from the
  version before it and replaces its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from roomlens.functions import text as tx
from roomlens.functions.numeric import stable_round
from roomlens.session import package_on_workers

BLOCK = 1000  # records in one state
COUNTS = ["correct", "graded", "pending", "total", "timed", "nanos"]
GRADE_SCHEMA = "file string, index long, correct boolean, note string, graded_at timestamp_ntz"
_CHANGE = "model string, task string, " + ", ".join(f"{c} long" for c in COUNTS)


def _order(value) -> tuple:
    """Nulls first, then by value."""
    return (value is not None, value if value is not None else 0)


def _latest(grade: list) -> tuple:
    """Order of grades as in the batch merge: time, then verdict, then note."""
    at, correct, note = grade
    return _order(at), _order(correct), (note is not None, note or "")


def _share(entry: dict) -> tuple[tuple[str, str], list[int]] | None:
    """(model, task) and counts of a record under its last grade."""
    rec = entry.get("rec")
    if rec is None:
        return None
    verdict = entry["grade"][1] if "grade" in entry else rec.get("c")
    nanos = rec.get("l")
    return (rec["m"], rec["t"]), [int(verdict is True), int(verdict is not None), int(verdict is None), 1,
                                  int(nanos is not None), nanos or 0]


def fold_block(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Differences that the new rows of one block make to the summary."""
    block = json.loads(state.get[0]) if state.exists else {}
    before: dict[str, tuple | None] = {}
    new: dict[str, str] = {}
    for frame in frames:
        for index, is_grade, body in zip(frame["index"], frame["is_grade"], frame["body"]):
            at = str(index)
            entry = block.setdefault(at, {})
            if at not in before:
                before[at] = _share(entry)
            row = json.loads(body)
            if is_grade:
                grade = [row.get("at"), row.get("c"), row.get("n")]
                if "grade" not in entry or _latest(grade) > _latest(entry["grade"]):
                    entry["grade"] = grade
            elif at not in new or body > new[at]:
                # a record that comes again replaces the earlier one
                new[at], entry["rec"] = body, row
    state.update((json.dumps(block),))
    change: dict[tuple, list[int]] = {}
    for at, old in before.items():
        for share, sign in ((old, -1), (_share(block[at]), 1)):
            if share:
                sums = change.setdefault(share[0], [0] * len(COUNTS))
                for i, n in enumerate(share[1]):
                    sums[i] += sign * n
    rows = [(*k, *v) for k, v in change.items() if any(v)]
    yield pd.DataFrame(rows, columns=["model", "task", *COUNTS])


def summary_changes(records: DataFrame, grades: DataFrame) -> DataFrame:
    """Streaming differences (model, task, counts) of two streams: records
    with `file` and `index`, and grade lines (`GRADE_SCHEMA`).  Negative or
    missing indexes and rows without a file are no record of any file."""
    rec = F.struct(F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("default")).alias("m"),
                   tx.task_label(F.col("task"), F.col("condition")).alias("t"), F.col("correct").alias("c"),
                   F.round(tx.record_latency() * 1e9).cast("long").alias("l"))
    grade = F.struct(F.unix_micros(F.col("graded_at").cast("timestamp")).alias("at"), F.col("correct").alias("c"),
                     F.col("note").alias("n"))
    both = records.select("file", "index", F.lit(False).alias("is_grade"), F.to_json(rec).alias("body")) \
        .union(grades.select("file", "index", F.lit(True), F.to_json(grade))) \
        .where("file is not null and index >= 0").withColumn("block", F.floor(F.col("index") / BLOCK))
    return both.groupBy("file", "block").applyInPandasWithState(
        fold_block, _CHANGE, "block string", "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ the sink
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def summary_versions(spark: SparkSession, out_dir: str) -> list[int]:
    """Numbers of the complete versions under ``out_dir``, ascending."""
    p, fs = _fs(spark, out_dir)
    if not fs.exists(p):
        return []
    names = [(m, st) for st in fs.listStatus(p) if (m := re.fullmatch(r"version=(\d+)", st.getPath().getName()))]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(m[1]) for m, st in names if fs.exists(done(st.getPath(), "_SUCCESS")))


def add_changes(changes: DataFrame, batch_id: int, out_dir: str, keep: int = 20) -> None:
    """Version ``batch_id``: the latest version before it plus ``changes``.
    Running a batch again gives the same version again.  Versions more than
    ``keep`` batches old are removed."""
    spark = changes.sparkSession
    cols = ["model", "task", *COUNTS]
    rows = changes.select(*cols)
    earlier = [v for v in summary_versions(spark, out_dir) if v < batch_id]
    if earlier:
        rows = rows.union(spark.read.parquet(f"{out_dir}/version={earlier[-1]}").select(*cols))
    # one row per model and task: a single file
    rows.groupBy("model", "task").agg(*[F.sum(c).alias(c) for c in COUNTS]).where("total > 0") \
        .coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/version={batch_id}")
    for old in earlier:
        if old < batch_id - keep:
            p, fs = _fs(spark, f"{out_dir}/version={old}")
            fs.delete(p, True)


def latest_summary(spark: SparkSession, out_dir: str) -> DataFrame:
    """A-9 rows of the newest version; no rows before the first batch."""
    versions = summary_versions(spark, out_dir)
    rows = spark.read.parquet(f"{out_dir}/version={versions[-1]}") if versions else spark.createDataFrame([], _CHANGE)
    mean = F.try_divide(F.col("nanos").cast("decimal(38,0)"), F.col("timed")).cast("double") / 1e9
    return rows.select("model", "task", "correct", "graded", "pending", "total",
                       stable_round(F.try_divide(F.col("correct"), F.col("graded")), 6).alias("accuracy"),
                       stable_round(mean, 6).alias("mean_latency_s"))


def graded_summary(spark: SparkSession, records_dir: str, grades_dir: str, schema: StructType, checkpoint_dir: str,
                   out_dir: str, every_seconds: int | None = None, max_files: int | None = None) -> StreamingQuery:
    """The running (with ``every_seconds``) or one-off (all files that are
    there) summary query.  ``records_dir`` has JSON lines with `file` and
    `index` beside the record's columns, ``grades_dir`` lines of
    `GRADE_SCHEMA`; both must exist.  `latest_summary(out_dir)` reads the
    result.  A query started again with the same folders goes on."""
    package_on_workers(spark)

    def stream(s, path: str) -> DataFrame:
        reader = spark.readStream.schema(s)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)
    changes = summary_changes(stream(schema, records_dir), stream(GRADE_SCHEMA, grades_dir))
    trigger = {"processingTime": f"{every_seconds} seconds"} if every_seconds else {"availableNow": True}
    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir) \
        .foreachBatch(lambda df, batch_id: add_changes(df, batch_id, out_dir)).trigger(**trigger).start()
