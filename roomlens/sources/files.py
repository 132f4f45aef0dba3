"""File sources and sinks (S-1 .. S-18).

Readers are Spark's own (csv, json, text, binaryFile) with explicit schemas
or string columns plus ``try_cast``; file names come from ``_metadata``.
A "file" of the reference (one CSV per room, one JSONL per run) is a Spark
output directory here (one folder of part files), so name-derived fields are
taken from the folder segment of the path.

All rows are read and written by Spark's own sources, but for
`write_binary_files`: no source of Spark writes single binary files.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOM_FILE_SUFFIX = "_measurements_IAQ_1h_avg.csv"
IMAGE_EXT_RE = r"(?i)\.(png|jpg|jpeg|webp)$"
PNG_MAGIC = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])


# ------------------------------------------------------------------ S-1..S-5
def write_room_csvs(rooms: dict[str, DataFrame], out_dir: str) -> list[str]:
    """One CSV folder per room, named like the reference's room files."""
    paths = []
    for room, df in rooms.items():
        p = os.path.join(out_dir, f"{room}{ROOM_FILE_SUFFIX}")
        df.write.mode("overwrite").option("header", True).csv(p)
        paths.append(p)
    return paths


def _first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Header line of each CSV (for a Spark-written folder, of its first part
    file), read through Hadoop's FileSystem on the driver: one short read per
    file, like a listing -- no data rows are read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        target = hp
        if fs.getFileStatus(hp).isDirectory():
            parts = sorted(str(st.getPath()) for st in fs.listStatus(hp)
                           if st.isFile() and not st.getPath().getName().startswith(("_", ".")))
            if not parts:
                continue
            target = jvm.org.apache.hadoop.fs.Path(parts[0])
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(target), "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line is not None:
            out[p] = line.lstrip("\ufeff")
    return out


def _file_name() -> Column:
    """Lower-cased name of the file a row came from (or of its folder, for
    Spark-written part files); the path is percent-decoded."""
    return F.lower(_own_name())


def _own_name() -> Column:
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    return F.element_at(F.filter(parts, lambda x: ~x.startswith("part-")), -1)


# Column types of room files beside the metrics, which are doubles.
_ROOM_TYPES = {"heat_stable": "boolean", "samples_per_hour": "int"}


def _typed(c: str, metric_cols: list[str]) -> Column | None:
    """The value of a typed column, NULL where its text does not parse; None
    for columns that stay text."""
    if c == "Date":
        return F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    if c in metric_cols:
        # NaN text would parse to NaN; the engine keeps NULL only (trap 1)
        v = F.col(c).try_cast("double")
        return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return F.col(c).try_cast(_ROOM_TYPES[c]) if c in _ROOM_TYPES else None


def _bad(c: str, metric_cols: list[str]) -> Column:
    """Whether a typed column holds a text that is no value: not NULL, not
    blank, and not a metric's NaN."""
    blank = F.trim(F.col(c)) == ""
    known = _typed(c, metric_cols).isNotNull()
    if c in metric_cols:
        known = known | F.isnan(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    return F.col(c).isNotNull() & ~blank & ~known


def _by_header(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One all-text read for each distinct header line, in its order."""
    by_header: dict[str, list[str]] = {}
    for path, header in _first_lines(spark, sorted(paths)).items():
        by_header.setdefault(header, []).append(path)
    if not by_header:
        raise FileNotFoundError("No IAQ CSV files found")
    return [spark.read.option("header", True).csv(by_header[h]) for h in sorted(by_header)]


def read_room_csvs(spark: SparkSession, paths: list[str], metric_cols: list[str],
                   quality: Observation | None = None) -> DataFrame:
    """S-1 + S-3 + S-4 + S-5: files are grouped by their header line and each
    group is one CSV read (so the plan grows with the number of distinct
    headers, not files); a missing location comes from the file name; types
    are coerced (bad timestamps/numbers become NULL); groups are unioned by
    name and columns sorted.

    ``quality`` is filled by the first action on the result, in the same pass:
    `rows`, and for each typed column `bad_<column>`, the texts that did not
    parse.  `room_csv_quality` has the counts by file."""
    parts, typed_cols = [], set()
    for df in _by_header(spark, paths):
        name_loc = F.regexp_extract(_file_name(), r"(?U)^(\w+)_measurements_iaq_1h_avg\.csv$", 1)
        if "location" not in df.columns:
            df = df.withColumn("location", F.when(name_loc != "", name_loc).otherwise(F.lit("unknown")))
        casts, flags = [], []
        for c in df.columns:
            typed = _typed(c, metric_cols)
            casts.append(F.lower(F.col(c)).alias(c) if c == "location" else F.col(c) if typed is None else typed.alias(c))
            if typed is not None and quality is not None:
                flags.append(_bad(c, metric_cols).alias(f"_bad_{c}"))
                typed_cols.add(c)
        parts.append(df.select(*casts, *flags))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    columns = sorted(c for c in out.columns if not c.startswith("_bad_"))
    if quality is not None:
        out = out.observe(quality, F.count(F.lit(1)).alias("rows"),
                          *[F.count_if(F.col(f"_bad_{c}")).alias(f"bad_{c}") for c in sorted(typed_cols)])
    return out.select(*columns)


def room_csv_quality(spark: SparkSession, paths: list[str], metric_cols: list[str]) -> DataFrame:
    """S-5's check: (file, column, rows, missing, bad) for every typed column
    of every file: rows read, values that are absent (NULL, blank or NaN) and
    texts that are no value of the column's type.  A file without rows gives
    none."""
    parts = []
    for df in _by_header(spark, paths):
        cols = [c for c in df.columns if _typed(c, metric_cols) is not None]
        counts = [F.struct(F.lit(c).alias("column"), F.col(f"_m_{i}").alias("missing"), F.col(f"_b_{i}").alias("bad"))
                  for i, c in enumerate(cols)]
        flagged = df.select(_own_name().alias("file"), *[x.alias(n) for i, c in enumerate(cols) for n, x in (
            (f"_b_{i}", _bad(c, metric_cols)), (f"_m_{i}", _typed(c, metric_cols).isNull() & ~_bad(c, metric_cols)))])
        sums = flagged.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *[
            F.count_if(F.col(n)).alias(n) for i in range(len(cols)) for n in (f"_b_{i}", f"_m_{i}")])
        parts.append(sums.select("file", "rows", F.inline(F.array(*counts))).select("file", "column", "rows", "missing", "bad"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def room_file_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, rows_read) of the scanned room files, by `_metadata`."""
    out = None
    for df in _by_header(spark, paths):
        names = df.select(_own_name().alias("file"))
        out = names if out is None else out.union(names)
    return out.groupBy("file").agg(F.count(F.lit(1)).alias("rows_read"))


def list_room_csvs(spark: SparkSession, folder: str) -> list[str]:
    """S-1: room files of a folder by their name pattern, sorted; the single
    override file wins if it is there (S-2)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    single = jvm.org.apache.hadoop.fs.Path(root, SINGLE_FILE)
    if fs.exists(single):
        return [str(single.toString())]
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, ROOM_GLOB))
    return sorted(str(f.getPath().toString()) for f in (found or []))


# File names of room measurements, and the one that replaces them all.
ROOM_GLOB = "*_measurements_IAQ_1h_avg.csv"
SINGLE_FILE = "measurements_IAQ_1h_avg.csv"


# ----------------------------------------------------------------------- S-8
def _nt_escape(c):
    for raw, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def _nt_unescape(c):
    """One pass over the escapes, via a private mark for the backslash."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\ue000"))
    for name, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(name), F.lit(raw))
    return F.replace(c, F.lit("\ue000"), F.lit("\\"))


def _nt_term(value, kind) -> F.Column:
    text = F.concat(F.lit('"'), _nt_escape(value), F.lit('"'))
    return (F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">")))
            .when(kind == "blank", F.concat(F.lit("_:"), value))
            .when(kind == "float", F.concat(text, F.lit("^^<http://www.w3.org/2001/XMLSchema#float>")))
            .otherwise(text))


def write_ntriples(triples: DataFrame, path: str) -> None:
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "),
                    _nt_term(F.col("o"), F.col("o_type")), F.lit(" ."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)


NT_LINE = (r'^\s*(?:<([^>]*)>|_:(\S+))\s*<([^>]*)>\s*'
           r'(?:<([^>]*)>|_:([^\s.]+(?:\.[^\s.]+)*)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$')


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples lines -> triples(s, p, o, o_type); o_type is iri, blank,
    float or string (other datatypes and language tags are read as strings).
    Comments and blank lines are skipped; `bad_ntriples` has the lines that
    are none of these."""
    t = spark.read.text(path).where(F.col("value").rlike(NT_LINE))
    got = [F.regexp_extract("value", NT_LINE, i) for i in range(9)]
    subject = F.when(got[1] != "", got[1]).otherwise(F.concat(F.lit("_:"), got[2]))
    return t.select(subject.alias("s"), got[3].alias("p"),
                    F.when(got[4] != "", got[4]).when(got[5] != "", got[5]).otherwise(_nt_unescape(got[6])).alias("o"),
                    F.when(got[4] != "", "iri").when(got[5] != "", "blank").when(got[7].endswith("#float"), "float")
                    .otherwise("string").alias("o_type"))


def bad_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither triples nor comments nor blank."""
    return spark.read.text(path).where(~F.col("value").rlike(NT_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


# -------------------------------------------------------------- S-14..S-16
def check_base64(df: DataFrame, b64_col: str) -> DataFrame:
    """S-16 over a base64 column: adds size (NULL if it does not decode),
    decodes, is_png (strict decoding and the magic bytes)."""
    raw = F.try_to_binary(F.col(b64_col), F.lit("base64"))
    return df.withColumn("_raw", raw).select(
        *df.columns, F.length("_raw").cast("long").alias("size"), F.col("_raw").isNotNull().alias("decodes"),
        F.coalesce(F.substring("_raw", 1, 8) == F.lit(PNG_MAGIC), F.lit(False)).alias("is_png"))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """S-14: recursive, image extensions case-insensitively, in order of the
    path, with the S-15 base64 text of each file.  A folder without images is
    a FileNotFoundError (only paths are read to see that).  Files of zero
    bytes do not appear: Spark's file sources do not list them."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .where(F.col("path").rlike(IMAGE_EXT_RE)))
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"No images found under {root}")
    return files.orderBy("path").select(F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.lower(F.regexp_extract("path", IMAGE_EXT_RE, 1)).alias("ext"),
                        F.base64("content").alias("b64"), F.element_at(F.split("path", "/"), -2).alias("folder"))


def write_binary_files(rows: DataFrame, path_col: str, content_col: str, root: str) -> int:
    """One file per row under ``root``, written by the tasks that hold the
    rows; the number of files.  Paths are relative and stay below ``root``;
    a null or other path or a null content is an error.  Of rows that share a
    path one is kept.  A repeated task replaces its files by equal ones.

    ``root`` must be mounted on every machine (a plain path or ``file:``)."""
    uri = urlparse(root)
    if uri.scheme not in ("", "file"):
        raise ValueError(f"tasks write into a mounted folder, {uri.scheme}:// is none")
    base = unquote(uri.path)

    def work(batches):
        import pyarrow as pa
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path is None or content is None or os.path.isabs(path) or ".." in path.split("/"):
                    raise ValueError(f"no file can be written for the path {path!r}")
                target = os.path.join(base, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    items = rows.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    return items.groupBy("path").agg(F.min("content").alias("content")) \
        .mapInArrow(work, "path string").count()


# ----------------------------------------------------------------------- S-17
# One response text per (model, stem); a Spark-written table names both in its
# folders, a plain folder tree in folder and file name.
ARTIFACT_RE = (r"/(?:model_dir=)?([^/]+)/(?:stem=)?(\d+)_([A-Za-z_]+?)_plot_(.+)_for_(\d{4}-\d{2}-\d{2})_in_([A-Za-z]+)"
               r"(?:\.txt|/[^/]*)$")


def write_artifacts(rows: DataFrame, root: str) -> None:
    """Response texts (model_dir, stem, content), a folder for each."""
    rows.repartition("model_dir", "stem").select(F.col("content").alias("value"), "model_dir", "stem") \
        .write.mode("overwrite").partitionBy("model_dir", "stem").text(root)


def pack_artifacts(rows: DataFrame, root: str) -> None:
    """The same texts in a packed container: many (path, content) rows a
    file, so millions of texts are not millions of folders.  The path is what
    a plain tree would have: model folder, then `stem.txt`."""
    rows.select(F.concat("model_dir", F.lit("/"), "stem", F.lit(".txt")).alias("path"), "content") \
        .write.mode("overwrite").parquet(root)


def scan_packed_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """`scan_artifacts` over a packed container."""
    t = spark.read.schema("path string, content string").parquet(root)
    return _artifact_columns(t, F.concat(F.lit("/"), F.col("path")), F.col("content"))


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Texts with what their path says; a file whose path says nothing stays,
    with its path and NULL elsewhere."""
    t = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return _artifact_columns(t, F.col("_metadata.file_path"), F.regexp_replace("value", r"\n$", ""))


def _artifact_columns(t: DataFrame, p: Column, text: Column) -> DataFrame:
    part = [F.nullif(F.regexp_extract(p, ARTIFACT_RE, i), F.lit("")) for i in range(7)]
    return t.select(part[1].alias("model"), part[2].try_cast("long").alias("index"), part[3].alias("condition"),
                    F.replace(part[4], F.lit("_"), F.lit(" ")).alias("metric_word"), part[5].alias("date"),
                    part[6].alias("location"), text.alias("text"),
                    F.when(part[0].isNull(), F.element_at(F.split(p, "/"), -1)).alias("stray"))


# ------------------------------------------------------------------------ S-9
def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; a line that is no such record
    keeps its row, with its text in `_corrupt_record` and NULL elsewhere.
    Folder names `key=value` come back as columns."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("basePath", path).json(path)
