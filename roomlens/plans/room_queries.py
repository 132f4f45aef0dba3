"""Registered room-analytics queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.functions.numeric import fixed_rows, stable_round

from roomlens.functions import text as tx
from roomlens.operators import room
from roomlens.sources import fixtures as fx
from roomlens.sources.tables import read_table

# Room words asked for in window questions; the last matches no room (F-7).
WINDOW_ROOMS = ["kitchen", "office", "hallway", "garage"]
# Metric words used in generated plot requests (G-3 labels).
PLOT_LABELS = [("temperature_c", "temperature"), ("humidity_rh", "humidity"), ("pressure_hpa", "pressure"),
               ("gas_resistance_ohms", "gas resistance"), ("IAQ_proxy", "IAQ")]


def q_daily_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room.daily_cards(fx.iaq(spark, sf_dir), room.metric_dim(spark))


# Location texts asked of the display route (a regex each).
CARD_LOCATIONS = ["kitchen", "Office", "hallway", "^h", "office|hall", "KIT", "garage", "(", None]


def card_request_table(iaq: DataFrame) -> DataFrame:
    """Every day in the data, from midnight and from half past one, x each
    asked location (none among them), plus one impossible date."""
    days = iaq.select(room.day_of().cast("string").alias("date")).distinct()
    days = days.unionByName(days.select(F.concat("date", F.lit(" 01:30")).alias("date"))) \
        .unionByName(iaq.sparkSession.createDataFrame([("2024-13-45",)], "date string"))
    req = days.select("date", fixed_rows(["location"], [(x,) for x in CARD_LOCATIONS]))
    return req.withColumn("request_id", F.concat_ws("|", "date", F.coalesce("location", F.lit("-"))))


def q_card_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    iaq = fx.iaq(spark, sf_dir)
    return room.cards_for_requests(card_request_table(iaq), iaq, room.metric_dim(spark))


def q_daily_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room.daily_ticker(fx.iaq(spark, sf_dir))


def q_location_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = room.location_stats(fx.iaq(spark, sf_dir))
    return s.select("location", "metric", *[stable_round(c, 6).alias(c) for c in ("mean", "min", "max")])


def _requests_from_days(iaq: DataFrame, rooms: list[str]) -> DataFrame:
    days = iaq.select(room.day_of().alias("d0")).distinct()
    # every day x fixed room list x metric: literal rows expanded per day
    return (days.select("d0", fixed_rows(["room"], [(r,) for r in rooms]))
            .select("d0", "room", fixed_rows(["metric"], [(m,) for m in room.METRICS]))
            .withColumn("d1", F.date_add("d0", 3))
            .withColumn("request_id", F.concat_ws("|", F.col("d0").cast("string"), "room", "metric")))


def q_window_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    iaq = fx.iaq(spark, sf_dir)
    m = room.window_means(_requests_from_days(iaq, WINDOW_ROOMS), room.day_totals(iaq))
    return m.select(F.col("d0").cast("string").alias("start_day"), "room", "metric",
                    stable_round("value_mean", 6).alias("value_mean"),
                    F.when(F.col("value_mean").isNull(), "no-data").otherwise("ok").alias("status"))


def q_value_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    iaq = fx.iaq(spark, sf_dir)
    return room.value_questions(fx.request_texts(spark, sf_dir), room.day_totals(iaq))


def q_parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = room.parsed_requests(fx.request_texts(spark, sf_dir))
    return p.select("request_id", "metric", "date_from", "date_to", F.col("room").alias("location"),
                    F.try_to_date("date_from", "yyyy-MM-dd").isNotNull().alias("date_ok"))


def q_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = room.daily_mean(fx.iaq(spark, sf_dir))
    return d.select("day", "location", "metric", stable_round("mean", 6).alias("mean"))


def q_hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = room.hourly_profile(fx.iaq(spark, sf_dir))
    return d.select("location", "hour", "metric", stable_round("mean", 6).alias("mean"))


def q_point_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for its room's readings at the event time."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    asks = ev.select(F.col("event_id").alias("ask_id"), F.col("ts").cast("timestamp_ntz").alias("asked_at"),
                     F.element_at(F.array(*[F.lit(r) for r in fx.ROOMS]),
                                  (F.col("user_id") % 3 + 1).cast("int")).alias("location"))
    return room.point_value(asks, fx.iaq(spark, sf_dir), ["temperature_c", "humidity_rh"])


def q_safe_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room.safe_limits(fx.iaq(spark, sf_dir), room.metric_dim(spark))


def q_oracle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room.expected_display(fx.iaq(spark, sf_dir), room.metric_dim(spark))


def q_result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows of each room's full result (`select * ... where room`)."""
    return room.result_status(fx.iaq(spark, sf_dir), room.metric_dim(spark), ["location"], "location")


def _plot_requests(iaq: DataFrame) -> DataFrame:
    """G-3 over the data: one request per (day, room, metric word)."""
    dr = iaq.select(room.day_of().cast("string").alias("expected_date"),
                    F.col("location").alias("expected_location")).distinct()
    return (dr.select("*", fixed_rows(["expected_metric", "label"], PLOT_LABELS))
            .withColumn("request", F.concat_ws(" ", F.lit("plot"), "label", F.lit("for"), "expected_date",
                                               F.lit("in"), "expected_location"))
            .withColumn("request_id", F.col("request")))


def q_series_with_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room.series_with_band(_all_plot_requests(spark, sf_dir), fx.iaq(spark, sf_dir), room.metric_dim(spark))


def q_series_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return room.series_requests(_all_plot_requests(spark, sf_dir), fx.iaq(spark, sf_dir))


def _all_plot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request texts of the orders (with and without dates, bad dates,
    unknown metrics) and one for a day that has no data."""
    return fx.request_texts(spark, sf_dir).select(F.col("request_id").cast("string").alias("request_id"), "request") \
        .union(spark.createDataFrame([("none", "plot temperature for 2030-01-01 in office")], "request_id string, request string"))


def q_score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-5: parse each generated plot request and compare with the case."""
    cases = room.parsed_requests(_plot_requests(fx.iaq(spark, sf_dir)))
    correct = ((F.col("metric") == F.col("expected_metric")) & (F.col("room") == F.col("expected_location"))
               & (F.col("date_from") == F.col("expected_date")))
    return cases.select("request", F.col("metric").alias("parsed_metric"),
                        F.col("room").alias("parsed_location"), F.col("date_from").alias("parsed_date"),
                        F.coalesce(correct, F.lit(False)).alias("correct"))


def q_score_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4 + K-13: stored card answers joined to the set-based oracle."""
    recs = fx.records(spark, sf_dir, with_index=False).where(F.col("task") == "display_cards")
    exp = room.expected_display(fx.iaq(spark, sf_dir), room.metric_dim(spark))
    r = recs.select("order_key", "model", F.col("query_params.date").alias("date"),
                    F.col("query_params.location").alias("location"),
                    F.col("query_params.metric").alias("metric"), "returned_value", "returned_state")
    j = r.join(exp, ["date", "location", "metric"], "left")
    ok = (F.col("returned_state") == F.col("expected_state")) & tx.is_close(F.col("returned_value"),
                                                                             F.col("expected_value"))
    return j.select("order_key", "model", "date", "location", "metric", "returned_value", "returned_state",
                    "expected_value", "expected_state", F.coalesce(ok, F.lit(False)).alias("correct"))


def q_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-7/L-2: first five readings in (Date, location) order (top-k)."""
    iaq = fx.iaq(spark, sf_dir)
    return (iaq.orderBy("Date", "location").limit(5)
            .select(F.col("Date").cast("string").alias("Date"), "location",
                    *[stable_round(m, 6).alias(m) for m in room.METRICS]))


def q_union_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-4/U-1: per-room parts with different columns, union by name,
    missing columns NULL, columns in sorted (ASCII) order."""
    iaq = fx.iaq(spark, sf_dir)
    parts = [iaq.where(F.col("location") == r) for r in fx.ROOMS]
    parts[1] = parts[1].drop("IAQ_class")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    u = u.select(*sorted(u.columns))
    return u.select(*[F.col(c).cast("string").alias(c) if c == "Date"
                      else stable_round(c, 6).alias(c) if c in room.METRICS else F.col(c) for c in u.columns])


QUERIES = {
    "daily_cards": q_daily_cards,
    "daily_ticker": q_daily_ticker,
    "card_requests": q_card_requests,
    "location_stats": q_location_stats,
    "window_value": q_window_value,
    "value_questions": q_value_questions,
    "parse_requests": q_parse_requests,
    "daily_mean": q_daily_mean,
    "hourly_profile": q_hourly_profile,
    "point_value": q_point_value,
    "safe_limit": q_safe_limit,
    "oracle_state": q_oracle_state,
    "result_status": q_result_status,
    "series_with_band": q_series_with_band,
    "series_requests": q_series_requests,
    "score_parse": q_score_parse,
    "score_cards": q_score_cards,
    "sample_rows": q_sample_rows,
    "union_rooms": q_union_rooms,
}
