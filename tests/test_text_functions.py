"""X-1..X-14, F-8, F-11, F-13 on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from roomlens.functions import text as tx


def one_col(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def col_values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_parse_metric_first_hit_in_map_order(spark):
    df = one_col(spark, ["temp and humidity in office", "Average HUMIDITY", "gas resistance now",
                         "temperatures", "nothing here", "iaq level"])
    got = col_values(df.select(tx.parse_metric(F.col("t")).alias("m")), "m")
    assert got[0] == "temperature_c"          # temp matches before humidity
    assert got[1] == "humidity_rh"
    assert got[2] == "gas_resistance_ohms"
    assert got[3] is None                     # word boundary: 'temperatures' is not 'temperature'
    assert got[4] is None


def test_parse_dates_and_room(spark):
    df = one_col(spark, ["kitchen from 2024-01-02 to 2024-01-05", "office hallway 2024-13-45", "garage"])
    out = df.select(tx.parse_request(F.col("t")).alias("r")).select("r.*").collect()
    assert (out[0].date_from, out[0].date_to, out[0].location) == ("2024-01-02", "2024-01-05", "kitchen")
    # no validity check on dates; room order kitchen, office, hallway
    assert (out[1].date_from, out[1].date_to, out[1].location) == ("2024-13-45", None, "office")
    assert (out[2].date_from, out[2].location) == (None, None)


@pytest.mark.parametrize("raw,expected", [
    ("  SELECT 1;  ", "SELECT 1"),
    ("`select 2`", "select 2"),
    ("text\n```sql\nselect a from iaq\n```\nmore", "select a from iaq"),
    ("```select 3", "select 3"),
    ("sql\nselect 4", "select 4"),
    ("Query: select 5; drop", "select 5"),
    ("Here is it: SELECT x FROM iaq", "SELECT x FROM iaq"),
    ("with a as (select 1) select * from a", "with a as (select 1) select * from a"),
    ("", ""),
    # str.splitlines / str.strip semantics (CRLF re-joined with \n, Unicode spaces)
    ("sql\r\nselect a\r\nfrom t", "select a\nfrom t"),
    ("\u3000select 1\u2003", "select 1"),
    ("SQL\u2028select 2", "select 2"),
])
def test_clean_sql_rules(spark, raw, expected):
    df = one_col(spark, [raw], "raw")
    assert col_values(tx.clean_sql(df, "raw", "sql"), "sql") == [expected]


def test_clean_sql_fence_takes_first_inner_part(spark):
    # the fenced part itself begins with the language line: a later rule drops it
    df = one_col(spark, ["```sql\nselect 9\n```"], "raw")
    assert col_values(tx.clean_sql(df, "raw", "sql"), "sql") == ["select 9"]


def test_guard_reason(spark):
    df = one_col(spark, ["select 1", "  WITH x as (select 1) select * from x", "delete from t",
                         "select updated_at from t", "select reflect('a','b')", "show tables"])
    got = col_values(df.select(tx.guard_reason(F.col("t")).alias("g")), "g")
    assert got == [None, None, "Only SELECT statements are allowed.", "Unsafe SQL detected.",
                   "Unsafe SQL detected.", "Only SELECT statements are allowed."]


def test_sql_valid_strips_all_whitespace(spark):
    # trap 13: leading newline/tab must be stripped like Python's strip()
    df = one_col(spark, ["\n\tselect 1", "explain select 1", None])
    assert col_values(df.select(tx.sql_valid(F.col("t")).alias("v")), "v") == [True, False, False]


def test_header_truthy(spark):
    df = one_col(spark, [" TRUE ", "yes", "0", None, "On", "\u00a0yes\x1c"])
    assert col_values(df.select(tx.header_truthy(F.col("t")).alias("v")), "v") == [True, True, False, False, True,
                                                                                   True]


def test_normalize_and_prediction_label(spark):
    df = one_col(spark, ["", "  It is SAFE!!  ", "Not safe: smoke", "The room is Ünsafe?", "unclear",
                         "Danger—fire", None])
    out = tx.parse_prediction(df, "t", "label")
    assert col_values(out, "label") == ["UNKNOWN", "SAFE", "UNSAFE", "SAFE", "UNKNOWN", "UNSAFE", "UNKNOWN"]
    norm = col_values(df.select(tx.normalize_text(F.col("t")).alias("n")), "n")
    assert norm[1] == "it is safe"
    assert norm[3] == "the room is ünsafe"       # trap 4: \w is Unicode


def test_record_latency_first_present_key(spark):
    df = spark.createDataFrame([("1.5", "9"), (None, "2.25"), ("bad", "3"), (None, None)], "a string, b string")
    got = col_values(df.select(tx.record_latency(F.col("a"), F.col("b")).alias("l")), "l")
    assert got == [1.5, 2.25, None, None]       # unparseable first value does not fall through


def test_task_label_null_condition(spark):
    df = spark.createDataFrame([("nl_sql", None), ("kg_ablation", "kg_on"), ("", ""), (None, "x")],
                               "task string, condition string")
    got = col_values(df.select(tx.task_label(F.col("task"), F.col("condition")).alias("l")), "l")
    assert got == ["nl_sql", "kg_ablation [kg_on]", "unknown", "unknown [x]"]


def test_task_type_and_sanitize(spark):
    df = one_col(spark, ["nl_sql_r1.jsonl", "kg_ablation_x.jsonl", "misc.jsonl", "  a b/c  ", "///"])
    got = col_values(df.select(tx.task_type_for_file(F.col("t")).alias("x")), "x")
    assert got[:3] == ["nl_sql", "kg_ablation", "other"]
    san = col_values(df.select(tx.sanitize_name(F.col("t")).alias("x")), "x")
    assert san[3] == "a_b_c" and san[4] == "_"


def test_is_close_and_extract_scalar(spark):
    df = spark.createDataFrame([(1.0, 1.005), (1.0, 1.02), (None, 1.0)], "a double, b double")
    assert col_values(df.select(tx.is_close(F.col("a"), F.col("b")).alias("c")), "c") == [True, False, False]
    arr = spark.createDataFrame([([["2.5"]],), ([["1", "2"]],), ([["x"]],), ([["1"], ["2"]],)],
                                "rows array<array<string>>")
    assert col_values(arr.select(tx.extract_scalar(F.col("rows")).alias("v")), "v") == [2.5, None, None, None]


def test_status_label(spark):
    df = one_col(spark, ["ok", "warn-high", "warn-low", "info", None])
    got = col_values(df.select(tx.status_label(F.col("t")).alias("s")), "s")
    assert got == ["Within range", "Above range", "Below range", "Info", "Info"]
