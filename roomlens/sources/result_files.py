"""Result files that are graded in place (J-7).

A result file is a partition `file=...` of a folder of JSON lines; a record's
position in its file is its `index` column.  Grading rewrites the files that
got a grade and no other: the new rows are written to a scratch folder first
(as Parquet, which is read again and sampled for the order more cheaply than
JSON lines), and replace the old partitions from there (dynamic partition
overwrite).  A
failure before the replacement changes nothing; after one during it the same
call gives the same files, as the last grade of a call wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomlens.operators import evaluate as ev
from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import remove_scratch, scratch_path

# Up to so many graded files are named in the scan's partition filter.
NAMED_FILES = 1000
_GRADED = [T.StructField("note", T.StringType()), T.StructField("graded_at", T.StringType())]


def result_schema(records: DataFrame) -> T.StructType:
    """Columns of the files of ``records``: theirs, `note` and `graded_at`."""
    own = [f for f in records.schema.fields if f.name not in ("note", "graded_at")]
    return T.StructType([T.StructField(f.name, f.dataType) for f in own] + _GRADED)


def _write(rows: DataFrame, path: str, **options) -> None:
    """A large file spans several parts, each a run of its records."""
    rows.repartitionByRange("file", "index").sortWithinPartitions("file", "index") \
        .write.mode("overwrite").options(**options).partitionBy("file").json(path)


def write_result_files(records: DataFrame, path: str) -> None:
    have = set(records.columns)
    _write(records.withColumns({f.name: F.lit(None).cast("string") for f in _GRADED if f.name not in have}), path)


def read_result_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def grade_result_files(spark: SparkSession, path: str, schema: T.StructType, grades: DataFrame) -> DataFrame:
    """Apply ``grades`` (file, index, correct, note, graded_at) to the files
    under ``path`` and return the rejected ones (unknown file, index out of
    range).  A record keeps the verdict, note and time of an earlier grading
    unless it is graded again.  Files without a valid grade are not touched."""
    wanted = broadcast_if_small(grades.where("file is not null").select("file").distinct())
    names = [r.file for r in wanted.limit(NAMED_FILES + 1).collect()]
    recs = read_result_files(spark, path, schema)
    recs = recs.where(F.col("file").isin(names)) if len(names) <= NAMED_FILES else recs.join(wanted, "file", "left_semi")
    staged = scratch_path(spark, "graded")
    last = ev.last_grades(grades).checkpoint()
    known = recs.select("file", "index").checkpoint()  # the files are parsed for it once
    hit = broadcast_if_small(known.join(last, ["file", "index"], "left_semi").select("file").distinct())
    ev.apply_grades(recs.join(hit, "file", "left_semi"), last).select(*[f.name for f in schema.fields]).write.parquet(staged)
    rejected = ev.rejected_grades(known, grades).checkpoint()
    if not hit.isEmpty():
        _write(spark.read.schema(schema).parquet(staged), path, partitionOverwriteMode="dynamic")
    remove_scratch(spark, staged)
    return rejected


def result_listing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A-11: the counts of each result file and `updated_at`, the time of its
    latest change."""
    own = [f.name for f in schema.fields]
    rows = read_result_files(spark, path, schema).select(*own, F.col("_metadata.file_modification_time").alias("_changed"))
    return ev.file_counts(rows, modified_col="_changed")
