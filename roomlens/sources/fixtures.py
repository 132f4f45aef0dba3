"""Bindings of the reference's data model to the driver's tables.

Each builder returns a lazy DataFrame derived from the given parquet tables
(FIXTURES.md section 2).  The DuckDB twin of every builder lives in
``roomlens.plans.oracle_sql`` and is written independently as plain SQL.

Scale notes
-----------
* ``iaq`` is an hourly roll-up of ``events``: one partial+final hash
  aggregate keyed by (hour, room); the map-side partial aggregate collapses a
  hot room before the shuffle, so a room holding a third of all events costs
  one pre-aggregated row per hour per map task.
* ``records`` needs a 0-based line index per result file.  A window
  ``row_number() over (partition by file)`` would put a whole file (a third
  of all rows here) into one task, so the index comes from
  ``operators.indexing.index_within_groups`` (range-partitioned sort + tiny
  per-partition offset table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.functions.numeric import stable_round

from roomlens.operators.indexing import index_within_groups
from roomlens.sources.tables import read_table

ROOMS = ["hallway", "kitchen", "office"]
METRIC_COLUMNS = ["temperature_c", "humidity_rh", "pressure_hpa", "gas_resistance_ohms", "IAQ_proxy"]


# --------------------------------------------------------------------------- iaq
def iaq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly room readings (Date timestamp_ntz, location, five metrics, ...)."""
    ev = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value")

    def mean_of(kind: str) -> Column:
        return F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(kind)

    room = (F.when(F.col("user_id") % 3 == 0, "hallway")
            .when(F.col("user_id") % 3 == 1, "kitchen").otherwise("office"))
    hourly = (ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("Date"),
                         room.alias("location"))
              .agg(mean_of("view"), mean_of("click"), mean_of("purchase"), mean_of("error"),
                   mean_of("signup"), F.count(F.lit(1)).cast("int").alias("n")))
    # Constants stay decimal literals (as in the SQL twin) so both engines
    # compute the same doubles.
    return hourly.select(
        "Date", "location",
        F.expr("23 + (day(Date) % 7 - 3) * 1.3 + (view - 50) * 0.06").alias("temperature_c"),
        F.expr("45 + (day(Date) % 5 - 2) * 8.0 + (click - 50) * 0.25").alias("humidity_rh"),
        F.expr("990 + purchase * 0.2").alias("pressure_hpa"),
        F.expr("1000 * error").alias("gas_resistance_ohms"),
        F.col("signup").alias("IAQ_proxy"),
        (F.col("n") >= 5).alias("heat_stable"),
        F.when(F.col("signup").isNull(), F.lit(None).cast("string"))
         .when(F.col("signup") < 25, "good").when(F.col("signup") < 75, "fair")
         .otherwise("poor").alias("IAQ_class"),
        F.col("n").alias("samples_per_hour"),
    )


# ----------------------------------------------------------------------- records
def records(spark: SparkSession, sf_dir: str, with_index: bool = True) -> DataFrame:
    """Evaluation records, one per order (see FIXTURES.md `records`).
    `index` (line number in the result file) is only built when asked for."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_totalprice", "o_orderdate", "o_orderpriority")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    task = (F.when(F.col("o_orderstatus") == "F", "nl_sql")
            .when(F.col("o_orderstatus") == "O", "display_cards")
            .when(F.col("o_orderstatus") == "P", "kg_ablation"))
    is_p = F.col("o_orderstatus") == "P"
    lat_text = F.when(key % 97 == 0, F.lit("bad")).otherwise(
        F.expr("cast(o_totalprice / 1e5 as string)"))
    room = F.element_at(F.array(*[F.lit(r) for r in ROOMS]), (cust % 3 + 1).cast("int"))
    day_text = F.concat(F.lit("2024-01-"), F.lpad((key % 30 + 1).cast("string"), 2, "0"))
    metric = F.element_at(F.array(*[F.lit(m) for m in METRIC_COLUMNS]), (key % 5 + 1).cast("int"))
    rec = o.select(
        key.alias("order_key"),
        F.concat(task, F.lit("_r"), (key % 4).cast("string"), F.lit(".jsonl")).alias("file"),
        task.alias("task"),
        F.when(is_p, F.when(key % 2 == 0, "kg_on").otherwise("kg_off")).alias("condition"),
        F.when(key % 17 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("model"),
        F.when(cust % 5 == 0, F.lit(None).cast("boolean"))
         .otherwise(cust % 5 != 4).alias("correct"),
        F.when(~is_p, lat_text).alias("latency_s"),
        F.when(is_p, F.expr("cast(o_totalprice / 2e5 as string)")).alias("latency_plot_s"),
        F.when(is_p, lat_text).alias("latency_total_s"),
        F.lit(None).cast("string").alias("latency_interp_s"),
        F.when(F.col("o_orderstatus") == "F",
               F.concat(F.lit("What is the average "), metric, F.lit(" of "), room, F.lit("?")))
         .alias("question"),
        F.when(F.col("o_orderstatus") == "F",
               F.concat(F.lit("select avg("), metric, F.lit(") from iaq")))
         .alias("generated_sql"),
        F.when(F.col("o_orderstatus") == "O",
               F.struct(day_text.alias("date"), room.alias("location"),
                        F.lit("08:15").alias("time"), metric.alias("metric")))
         .alias("query_params"),
        F.when(F.col("o_orderstatus") == "O", stable_round(F.col("o_totalprice") / 1e4, 2))
         .alias("returned_value"),
        F.when(F.col("o_orderstatus") == "O",
               F.when(cust % 3 == 0, "ok").when(cust % 3 == 1, "warn-low"))
         .alias("returned_state"),
        F.when(is_p, F.concat(F.lit("plot temperature for "), day_text, F.lit(" in "), room))
         .alias("plot_request"),
        F.when(is_p & (key % 3 == 1), F.concat(F.lit("please show me "), room)).alias("request_text"),
        F.when(is_p & (key % 3 != 0), F.concat(F.lit("The readings look "),
                                              F.when(cust % 2 == 0, "stable").otherwise("noisy")))
         .alias("model_response"),
    )
    return index_within_groups(rec, ["file"], "order_key", "index") if with_index else rec


def grades(spark: SparkSession, sf_dir: str, recs: DataFrame | None = None) -> DataFrame:
    """Grade requests: one per returned line item of a recorded order."""
    recs = recs if recs is not None else records(spark, sf_dir)
    li = (read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag",
                     "l_linestatus", "l_shipdate")
          .where(F.col("l_returnflag") == "R"))
    return (recs.select("order_key", "file", "index")
            .join(li, F.col("order_key") == F.col("l_orderkey"))
            # line 7 of an order points past the end of its file: a grade to reject
            .select("file", (F.col("index") + F.when(F.col("l_linenumber") == 7, 1000000).otherwise(0))
                    .alias("index"),
                    (F.col("l_linestatus") == "F").alias("correct"),
                    F.concat(F.lit("  "), F.col("l_linenumber").cast("string"), F.lit(" "))
                     .alias("note"),
                    F.col("l_shipdate").cast("timestamp_ntz").alias("graded_at")))


# ------------------------------------------------------------------- predictions
def model_text_expr() -> Column:
    return F.expr("""case when doc_id % 11 = 0 then ''
                          when doc_id % 11 = 1 then 'ERROR: 500 Server Error'
                          when (doc_id % 7 = 0) <> (toxic = 1) then '**UNSAFE**'
                          when doc_id % 5 = 0 then 'Not-safe: smoke'
                          else 'Safe.' end""")


def prediction_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the stored model text (before parsing)."""
    lab = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    return (lab.join(docs, "doc_id")
            .select(F.lit("r1").alias("run"), F.col("lang").alias("model"),
                    F.when(F.col("toxic") == 1, "UNSAFE").otherwise("SAFE").alias("true_label"),
                    (F.col("n_chars") / F.lit(1e3)).alias("latency_s"),
                    model_text_expr().alias("model_text"),
                    F.col("doc_id").cast("string").alias("image_path")))


# ---------------------------------------------------------------------- requests
def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot/value requests, one per order, in seven variants (key % 7)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    labels = F.array(*[F.lit(x) for x in ["temperature", "humidity", "pressure", "gas resistance", "IAQ"]])
    rooms = F.array(*[F.lit(r) for r in ROOMS])
    m = F.element_at(labels, (key % 5 + 1).cast("int"))
    r1 = F.element_at(rooms, (cust % 3 + 1).cast("int"))
    r2 = F.element_at(rooms, ((cust + 1) % 3 + 1).cast("int"))
    d1n = key % 25 + 1
    d1 = F.concat(F.lit("2024-01-"), F.lpad(d1n.cast("string"), 2, "0"))
    d2 = F.concat(F.lit("2024-01-"), F.lpad((d1n + 1 + cust % 5).cast("string"), 2, "0"))
    v = key % 7
    text = (F.when(v == 0, F.concat_ws(" ", F.lit("plot"), m, F.lit("for"), d1, F.lit("in"), r1))
            .when(v == 1, F.concat_ws(" ", F.lit("plot"), m, F.lit("from"), d1, F.lit("to"), d2,
                                      F.lit("in"), r1))
            .when(v == 2, F.concat_ws(" ", F.lit("plot"), m, F.lit("in"), r1))
            .when(v == 3, F.concat_ws(" ", F.lit("plot"), m, F.lit("for"), d1))
            .when(v == 4, F.concat_ws(" ", F.lit("plot"), m, F.lit("for 2024-13-45 in"), r1))
            .when(v == 5, F.concat_ws(" ", F.lit("plot wind speed for"), d1, F.lit("in"), r1))
            .otherwise(F.concat_ws(" ", F.lit("plot"), m, F.lit("for"), d1, F.lit("in"), r1,
                                   F.lit("and"), r2)))
    return o.select(key.alias("request_id"), text.alias("request"))


def generated_sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs that should contain one SQL statement, in ten wrappings."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return o.select(F.col("o_orderkey").alias("text_id"), generated_sql_expr().alias("raw_text"))


def generated_sql_expr() -> Column:
    """The model output of an order, from its keys."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    aggs = F.array(*[F.lit(a) for a in ["avg", "min", "max"]])
    cols = F.array(*[F.lit(c) for c in METRIC_COLUMNS])
    rooms = F.array(*[F.lit(r) for r in ROOMS])
    base = F.concat(F.lit("select "), F.element_at(aggs, (cust % 3 + 1).cast("int")), F.lit("("),
                    F.element_at(cols, (key % 5 + 1).cast("int")),
                    F.lit(") from iaq where lower(location) like '%"),
                    F.element_at(rooms, ((cust + key) % 3 + 1).cast("int")), F.lit("%'"))
    v = key % 10
    return (F.when(v == 0, base)
            .when(v == 1, F.concat(F.lit("```"), base, F.lit("```")))
            .when(v == 2, F.concat(F.lit("```sql\n"), base, F.lit("\n```")))
            .when(v == 3, F.concat(F.lit("SQL: "), base))
            .when(v == 4, F.concat(F.lit("Here is the query you asked for:\n"), base))
            .when(v == 5, F.concat(F.lit("\n  "), base, F.lit("; drop table iaq")))
            .when(v == 6, F.concat(F.lit("Sure. with t as ("), base, F.lit(") select * from t")))
            .when(v == 7, F.lit("select updated_at from iaq"))
            .when(v == 8, F.lit("select transform(location) using 'cat' as (x string) from iaq")))
