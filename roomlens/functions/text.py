"""Text parsing and labelling as built-in column expressions (X-1 .. X-18).

Everything here is a Catalyst expression (regexp_*, split, when chains), so
it runs JVM-side inside whole-stage codegen; no Python UDF is involved.
Java regex notes: ``\\w``/``\\s`` are ASCII unless ``(?U)`` is given; Python's
are Unicode, so the normaliser uses ``(?U)`` (SURVEY 2.12 trap 4).  Python's
``str.strip()`` removes all whitespace, Spark's ``trim`` only spaces, hence
``strip_ws`` (trap 13).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlens.sources.tables import spread

# Question-word -> metric column, tested in this order (X-1).
METRIC_WORDS = [
    ("temperature", "temperature_c"),
    ("temp", "temperature_c"),
    ("humidity", "humidity_rh"),
    ("pressure", "pressure_hpa"),
    ("iaq", "IAQ_proxy"),
    ("iaq score", "IAQ_proxy"),
    ("gas resistance", "gas_resistance_ohms"),
]
# Room names tested in this order as substrings (X-3).
ROOM_WORDS = ["kitchen", "office", "hallway"]
# Words that make a statement unsafe for the read-only guard (F-8).
GUARD_WORDS = ["insert", "update", "delete", "drop", "alter", "create", "attach", "copy", "pragma"]
# Extra Spark-only escape hatches refused by the guard (trap 7).
SPARK_GUARD_WORDS = ["reflect(", "java_method(", "try_reflect("]
# Script transformation runs a shell command: TRANSFORM/MAP/REDUCE ... USING '<command>'.  A join's
# USING is followed by a bracket.
SCRIPT_RULE = r"(?s)\b(transform|map|reduce)\b.*\busing\b\s*[^\s(]"
# Truthy header spellings for the KG off-switch (F-13).
TRUTHY = ["1", "true", "yes", "on"]
# Markers for the safety label parser (X-7).
UNSAFE_MARKERS = ["unsafe", "not safe", "danger", "fire", "smoke"]
# Result-file task prefixes (X-10).
TASK_PREFIXES = ["nl_sql", "display_cards", "plot_gen", "chart_interp", "kg_ablation"]
# Latency keys, first present wins (X-8).
LATENCY_KEYS = ["latency_total_s", "latency_s", "latency_interp_s", "latency_plot_s"]
# Metric column -> knowledge-graph label and display title (K-12).
METRIC_DIM = [
    ("temperature_c", "temperature", "Temperature"),
    ("humidity_rh", "humidity", "Humidity"),
    ("pressure_hpa", "pressure", "Pressure"),
    ("IAQ_proxy", "iaq score", "IAQ score"),
    ("gas_resistance_ohms", "gas resistance", "gas_resistance_ohms"),
]


# Python's whitespace (str.isspace) and line boundaries (str.splitlines),
# derived from Python itself; Java's and RE2's \s are narrower.
PY_SPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())
PY_STRIP = f"^[{PY_SPACE}]+|[{PY_SPACE}]+$"
PY_LINE_BREAK = "\r\n|[" + "".join(ch for ch in PY_SPACE if len(("a" + ch + "b").splitlines()) == 2) + "]"


def strip_ws(c: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(c, PY_STRIP, "")


# ------------------------------------------------------------ request parsing
def parse_metric(q: Column) -> Column:
    ql = F.lower(q)
    return F.coalesce(*[F.when(ql.rlike(rf"\b{w}\b"), F.lit(m)) for w, m in METRIC_WORDS])


def parse_dates(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(r"(20\d{2}-\d{2}-\d{2})"), 1)


def parse_room(q: Column) -> Column:
    ql = F.lower(q)
    return F.coalesce(*[F.when(ql.contains(r), F.lit(r)) for r in ROOM_WORDS])


def parse_request(q: Column) -> Column:
    """X-4: struct(metric, date_from, date_to, location)."""
    dates = parse_dates(q)
    return F.struct(parse_metric(q).alias("metric"), F.get(dates, 0).alias("date_from"),
                    F.get(dates, 1).alias("date_to"), parse_room(q).alias("location"))


# ---------------------------------------------------------------- SQL cleaning
def clean_sql(df: DataFrame, raw_col: str, out_col: str = "sql") -> DataFrame:
    """X-5: pull one statement out of model text, rules applied in order.

    One projection per rule: each rule reads the previous text two or three
    times, so nesting them as one expression would repeat every earlier
    regex per reference (a tree that grows multiplicatively and overflows
    generated code).  Separate projections are not collapsed by Catalyst
    when that would duplicate non-trivial expressions, so each regex runs
    once per row."""
    df = spread(df)   # regex rules are CPU-bound per row
    t = F.col("_t")
    steps = [
        strip_ws(F.regexp_replace(strip_ws(F.col(raw_col)), r"^`+|`+$", "")),   # caller: strip().strip("`")
        F.when(F.size(F.split(t, "```", -1)) >= 3, strip_ws(F.get(F.split(t, "```", -1), 1)))
         .when(t.contains("```"), strip_ws(F.replace(t, F.lit("```"), F.lit("")))).otherwise(t),
        # first line is `sql`: the other lines, re-joined with \n (splitlines)
        F.when(F.get(F.split(t, PY_LINE_BREAK, 2), 0).rlike(r"(?iU)^\s*sql\s*$"),
               strip_ws(F.regexp_replace(F.coalesce(F.get(F.split(t, PY_LINE_BREAK, 2), 1), F.lit("")),
                                         PY_LINE_BREAK, "\n"))).otherwise(t),
        F.regexp_replace(t, r"(?i)^\s*(sql|query)\s*:\s*", ""),
        F.when(~t.rlike(r"(?i)^\s*(select|with)\b") & t.rlike(r"(?i)\bselect\b"),
               F.regexp_extract(t, r"(?is)^.*?(\bselect\b.*)$", 1)).otherwise(t),
        strip_ws(F.substring_index(t, ";", 1)),
    ]
    for e in steps:
        df = df.withColumn("_t", e)
    raw = F.col(raw_col)
    return (df.withColumn(out_col, F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(t))
            .drop("_t"))


def guard_reason(sql: Column) -> Column:
    """F-8: NULL when allowed, else the reason text the reference raises."""
    s = F.lower(strip_ws(F.coalesce(sql, F.lit(""))))
    bad = "|".join(GUARD_WORDS)
    spark_bad = "|".join(w.replace("(", r"\(") for w in SPARK_GUARD_WORDS)
    return (F.when(~s.rlike(r"^(select|with)"), F.lit("Only SELECT statements are allowed."))
            .when(s.rlike(bad) | s.rlike(spark_bad) | s.rlike(SCRIPT_RULE), F.lit("Unsafe SQL detected.")))


def sql_valid(sql: Column) -> Column:
    """F-11: generated text starts with select/with after whitespace strip."""
    return F.coalesce(F.lower(strip_ws(sql)).rlike(r"^(select|with)"), F.lit(False))


def header_truthy(v: Column) -> Column:
    """F-13."""
    return F.coalesce(F.lower(strip_ws(v)).isin(*TRUTHY), F.lit(False))


# -------------------------------------------------------- prediction labelling
def normalize_text(t: Column) -> Column:
    """X-6: lower, non-word/non-space -> space, strip, collapse spaces."""
    x = F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", " ")
    return F.regexp_replace(strip_ws(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def parse_prediction(df: DataFrame, text_col: str, out_col: str = "pred_label") -> DataFrame:
    """X-7: empty -> UNKNOWN; any unsafe marker -> UNSAFE; 'safe' -> SAFE.
    The normalised text is its own projection (it is tested six times)."""
    df = df.withColumn("_norm", normalize_text(F.coalesce(F.col(text_col), F.lit(""))))
    n = F.col("_norm")
    unsafe = None
    for m in UNSAFE_MARKERS:
        unsafe = n.contains(m) if unsafe is None else (unsafe | n.contains(m))
    label = (F.when(n == "", "UNKNOWN").when(unsafe, "UNSAFE")
             .when(n.contains("safe"), "SAFE").otherwise("UNKNOWN"))
    return df.withColumn(out_col, label).drop("_norm")


# ------------------------------------------------------------ record helpers
def record_latency(*cols: Column) -> Column:
    """X-8: first non-NULL key wins; if it does not parse the result is NULL."""
    cols = cols or tuple(F.col(k) for k in LATENCY_KEYS)
    return F.coalesce(*cols).try_cast("double")


def task_label(task: Column, condition: Column) -> Column:
    """X-9: `task [condition]`, `unknown` for an empty task (trap 16)."""
    base = F.coalesce(F.nullif(task, F.lit("")), F.lit("unknown"))
    return F.concat(base, F.coalesce(F.concat(F.lit(" ["), F.nullif(condition, F.lit("")), F.lit("]")),
                                     F.lit("")))


def task_type_for_file(name: Column) -> Column:
    """X-10."""
    return F.coalesce(*[F.when(name.startswith(p + "_"), F.lit(p)) for p in TASK_PREFIXES],
                      F.lit("other"))


def is_close(left: Column, right: Column, tol: float = 0.01) -> Column:
    """X-11: absolute tolerance, NULL -> false."""
    return F.coalesce(F.abs(left - right) <= F.lit(tol), F.lit(False))


def extract_scalar(rows: Column) -> Column:
    """X-12: exactly one row of one column that parses as a double."""
    one = (F.size(rows) == 1) & (F.size(F.get(rows, 0)) == 1)
    return F.when(one, F.get(F.get(rows, 0), 0).try_cast("double"))


def sanitize_name(v: Column, default: str = "default") -> Column:
    """X-13."""
    return F.coalesce(F.nullif(F.regexp_replace(strip_ws(v), r"[^A-Za-z0-9._-]+", "_"), F.lit("")),
                      F.lit(default))


def range_text(lo: Column, hi: Column) -> Column:
    """X-17: ` (comfort 20.0 – 26.0)`, a dash for a missing bound; empty
    without bounds."""
    side = [F.when(c.isNotNull(), F.format_string("%.1f", c)).otherwise("–") for c in (lo, hi)]
    return F.when(lo.isNotNull() | hi.isNotNull(),
                  F.concat(F.lit(" (comfort "), side[0], F.lit(" – "), side[1], F.lit(")"))).otherwise("")


def status_label(status: Column) -> Column:
    """X-17: status -> display text."""
    return (F.when(status == "ok", "Within range").when(status == "warn-high", "Above range")
            .when(status == "warn-low", "Below range").otherwise("Info"))
