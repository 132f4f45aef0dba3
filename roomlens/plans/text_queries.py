"""Registered text queries: SQL cleaning/guarding, guarded execution,
generated-SQL scoring, prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.functions import text as tx
from roomlens.functions.numeric import stable_round
from roomlens.operators import cases, kg, room
from roomlens.operators.sqlguard import guarded_sql
from roomlens.sources import fixtures as fx
from roomlens.sources.tables import read_table

# A-22's first suggested question, as a user would type it for the guarded SQL surface.
DAILY_AVG_SQL = (
    "select cast(cast(`Date` as date) as string) as day, location, "
    "round(round(avg(temperature_c), 8), 6) as avg_temp, round(round(avg(humidity_rh), 8), 6) as avg_hum "
    "from iaq where lower(location) like '%kitchen%' group by 1, 2")

# Statements as users type them for the guarded SQL surface: what the engine
# has no operator for is reached this way.  They run as they stand in both
# engines.
GUARDED_SQL = {
    "semi_join": """
        select a.location, cast(cast(a.Date as date) as string) as day, count(*) as n from iaq a
        where exists (select 1 from iaq b where b.Date = a.Date and b.location <> a.location and b.temperature_c > a.temperature_c)
        group by 1, 2""",
    "anti_join": """
        select cast(a.Date as string) as at, a.location from iaq a
        where not exists (select 1 from iaq b where b.Date = a.Date and b.location <> a.location and b.samples_per_hour >= a.samples_per_hour)""",
    "range_join": """
        select a.location, cast(cast(a.Date as date) as string) as day, count(*) as warmer_within_3h from iaq a
        join iaq b on b.location = a.location and cast(b.Date as date) = cast(a.Date as date)
          and b.Date > a.Date and b.Date <= a.Date + interval 3 hours and b.temperature_c > a.temperature_c
        group by 1, 2""",
    "intersect": """
        select cast(cast(Date as date) as string) as day, hour(Date) as hr from iaq where location = 'kitchen' and temperature_c > 23
        intersect select cast(cast(Date as date) as string), hour(Date) from iaq where location = 'office' and temperature_c > 23""",
    "except": """
        select cast(cast(Date as date) as string) as day, IAQ_class from iaq where location = 'hallway'
        except select cast(cast(Date as date) as string), IAQ_class from iaq where location = 'office'""",
    "distinct_aggregates": """
        select location, count(distinct IAQ_class) as classes, count(distinct cast(Date as date)) as days,
               cast(sum(distinct samples_per_hour) as bigint) as sizes, count(distinct IAQ_class, heat_stable) as pairs
        from iaq group by location""",
    "grouping_sets": """
        select location, IAQ_class, count(*) as n from iaq
        group by grouping sets ((location, IAQ_class), (location), ())""",
    "cube": """
        select location, heat_stable, cast(grouping(location) as int) as all_rooms, cast(grouping(heat_stable) as int) as all_states,
               count(*) as n, max(samples_per_hour) as most from iaq group by cube (location, heat_stable)""",
    "rollup": """
        select location, cast(cast(Date as date) as string) as day, count(*) as n, cast(sum(samples_per_hour) as bigint) as samples
        from iaq group by rollup (location, cast(cast(Date as date) as string))""",
    "window": """
        select cast(Date as string) as at, location, samples_per_hour - lag(samples_per_hour) over w as step,
               cast(rank() over (partition by cast(Date as date) order by samples_per_hour desc, Date, location) as int) as rk
        from iaq window w as (partition by location, cast(Date as date) order by Date)""",
}

# Prompt text blocks of the question-to-SQL request (X-19).
SYSTEM_SQL = ("You are a data assistant that writes a single valid DuckDB SQL query to answer a question. "
              "Only output the SQL. Do not include explanations or code fences.")
LOCATIONS_HINT = ("Locations are in column 'location' (values include kitchen, hallway, office). "
                  "Only add a location WHERE clause when the question asks for a specific location; "
                  "for kitchen, use WHERE lower(location) LIKE '%kitchen%'. \n")
COMFORT_CONTEXT = ("Comfort context: recommended temperature range is 20-26 C and recommended humidity "
                   "range is 30-60% when those metrics are relevant.")
CLOSING = "Return ONLY one DuckDB SQL statement that starts with SELECT and uses table iaq."
# X-KG-Disabled header sent with each conversation (conv_id % 5).
KG_HEADERS = [None, " TRUE ", "yes", "off", "0"]


def q_clean_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.generated_sql_texts(spark, sf_dir)
    return tx.clean_sql(g, "raw_text", "sql").select("text_id", "sql")


def q_guard_sql(spark, sf_dir):
    g = q_clean_sql(spark, sf_dir)
    reason = tx.guard_reason(F.col("sql"))
    return g.select("text_id", "sql", reason.isNull().alias("allowed"), reason.alias("reason"),
                    tx.sql_valid(F.col("sql")).alias("valid_sql"))


def q_guarded_query(spark, sf_dir):
    return guarded_sql(spark, DAILY_AVG_SQL, {"iaq": fx.iaq(spark, sf_dir)})


def _guarded(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return guarded_sql(spark, sql, {"iaq": fx.iaq(spark, sf_dir)})
    return run


def q_score_generated_sql(spark, sf_dir):
    """J-3: stored answers of the question-to-SQL task scored against the
    set-based ground truth (A-1), with X-12 extraction and X-11 tolerance.

    Every answer gives a row: one whose (room, metric, aggregate) is no listed
    case has status `no-case` and no grade.  The answer's text is cleaned in
    the same pass over the answers; the cases are at most rooms x metrics x
    aggregates rows and join as AQE sees fit."""
    iaq = fx.iaq(spark, sf_dir)
    truth = room.location_stats(iaq).unpivot(["location", "metric"], ["mean", "min", "max"], "agg", "expected")
    qcases = cases.question_cases(iaq).join(truth, ["location", "metric", "agg"]) \
        .select("location", "metric", "agg", "text", "expected")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority") \
        .where(F.col("o_orderstatus") == "F")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ans = o.select(key.alias("order_key"), F.col("o_orderpriority").alias("model"),
                   F.element_at(F.array(*[F.lit(r) for r in fx.ROOMS]), (cust % 3 + 1).cast("int")).alias("location"),
                   F.element_at(F.array(*[F.lit(m) for m in fx.METRIC_COLUMNS]), (key % 5 + 1).cast("int")).alias("metric"),
                   F.element_at(F.array(F.lit("mean"), F.lit("min"), F.lit("max")),
                                (F.floor(key / 5) % 3 + 1).cast("int")).alias("agg"),
                   fx.generated_sql_expr().alias("raw_text"))
    j = tx.clean_sql(ans, "raw_text", "sql").join(qcases, ["location", "metric", "agg"], "left")
    delta = F.element_at(F.array(F.lit(0.0), F.lit(0.004), F.lit(0.03)), (F.col("order_key") % 3 + 1).cast("int"))
    v = (F.col("expected") + delta).cast("string")
    k4 = F.col("order_key") % 4
    rows = (F.when(k4 == 0, F.array().cast("array<array<string>>"))
            .when(k4 == 1, F.array(F.array(v)))
            .when(k4 == 2, F.array(F.array(v, F.lit("x"))))
            .otherwise(F.array(F.array(F.lit("n/a")))))
    listed = F.col("text").isNotNull()
    j = j.withColumn("result_value", tx.extract_scalar(rows)).withColumn("valid_sql", tx.sql_valid(F.col("sql")))
    return j.select("order_key", "model", F.col("text").alias("question"), F.col("sql").alias("generated_sql"),
                    stable_round("result_value", 6).alias("result_value"),
                    stable_round("expected", 6).alias("expected_value"), "valid_sql",
                    F.when(listed, F.col("valid_sql") & tx.is_close(F.col("result_value"), F.col("expected")))
                    .alias("correct"),
                    F.when(listed, F.lit("scored")).otherwise(F.lit("no-case")).alias("status"))


def schema_text(iaq: DataFrame) -> str:
    """`name (type)` lines of the merged table in sorted column order
    (metadata only; no data reaches the driver)."""
    types = dict(iaq.dtypes)
    return "\n".join(f"{c} ({types[c]})" for c in sorted(types))


def sample_text(iaq: DataFrame, n: int = 5) -> str:
    """The first ``n`` rows by (Date, location) as a JSON list, columns in
    sorted order (n rows reach the driver, whatever the table)."""
    shown = []
    for c, kind in sorted(iaq.dtypes):
        v = F.col(c)
        if kind == "double":
            shown.append(stable_round(v, 6).cast("string"))
        elif kind in ("int", "boolean"):
            shown.append(v.cast("string"))
        else:
            shown.append(F.concat(F.lit('"'), v.cast("string"), F.lit('"')))
    cells = [F.concat(F.lit(f'"{c}": '), F.coalesce(x, F.lit("null"))) for (c, _), x in zip(sorted(iaq.dtypes), shown)]
    row = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}")).alias("row")
    return "[" + ", ".join(r.row for r in iaq.orderBy("Date", "location").limit(n).select(row).collect()) + "]"


def q_prompt_assembly(spark, sf_dir):
    """X-19 + F-13 + K-7 over the user turns of every conversation."""
    iaq = fx.iaq(spark, sf_dir)
    conv = (read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
            .where(F.col("role") == "user")
            .withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn")))
    headers = F.array(*[F.lit(h) if h is not None else F.lit(None).cast("string") for h in KG_HEADERS])
    # F-13: the request's own flag (every 7th turn has it) or the header
    conv = conv.withColumn("kg_disabled", (F.col("turn") % 7 == 6) | tx.header_truthy(
        F.element_at(headers, (F.col("conv_id") % len(KG_HEADERS) + 1).cast("int"))))
    ctx = kg.fact_context(kg.seed_triples(spark), conv.select("text_id", "text"), "text_id", "text", 6)
    j = conv.join(ctx, "text_id", "left")
    kg_part = F.when(~F.col("kg_disabled"), F.concat(
        F.lit(COMFORT_CONTEXT),
        F.when(F.col("context") != "", F.concat(F.lit("\nRelevant KG facts:\n"), F.col("context"))).otherwise(F.lit("")),
        F.lit("\n\n"))).otherwise(F.lit(""))
    head = (f"{SYSTEM_SQL}\n{LOCATIONS_HINT}Table name: iaq\n"
            f"Schema (name (dtype)):\n{schema_text(iaq)}\n\n"
            f"Sample rows (JSON):\n{sample_text(iaq)}\n\n")
    prompt = F.concat(F.lit(head), kg_part, F.lit("Question: "), F.coalesce("text", F.lit("")),
                      F.lit("\n\n" + CLOSING))
    return j.select("conv_id", "turn", "kg_disabled", F.coalesce("n_lines", F.lit(0)).alias("n_facts"),
                    prompt.alias("prompt"))


QUERIES = {
    "clean_sql": q_clean_sql,
    "guard_sql": q_guard_sql,
    "guarded_query": q_guarded_query,
    **{f"guarded_{name}": _guarded(sql) for name, sql in GUARDED_SQL.items()},
    "score_generated_sql": q_score_generated_sql,
    "prompt_assembly": q_prompt_assembly,
}
