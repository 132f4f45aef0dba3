"""G-1..G-5: evaluation cases generated from the data (rooms and days
present in ``iaq``) crossed with the fixed metric/question/rubric lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlens.functions.numeric import fixed_rows
from roomlens.operators.indexing import index_within_groups

# Metric column, question word, in case order.
CASE_METRICS = [
    ("temperature_c", "temperature"),
    ("humidity_rh", "humidity"),
    ("pressure_hpa", "pressure"),
    ("gas_resistance_ohms", "gas resistance"),
    ("IAQ_proxy", "IAQ"),
]
# The listed min/max question cases (location, metric, word, agg, agg word).
MINMAX_CASES = [
    ("hallway", "temperature_c", "temperature", "min", "minimum"),
    ("hallway", "humidity_rh", "humidity", "max", "maximum"),
    ("hallway", "pressure_hpa", "pressure", "min", "minimum"),
    ("hallway", "gas_resistance_ohms", "gas resistance", "max", "maximum"),
    ("hallway", "IAQ_proxy", "IAQ", "min", "minimum"),
    ("kitchen", "temperature_c", "temperature", "max", "maximum"),
    ("kitchen", "humidity_rh", "humidity", "min", "minimum"),
    ("kitchen", "pressure_hpa", "pressure", "max", "maximum"),
    ("kitchen", "gas_resistance_ohms", "gas resistance", "min", "minimum"),
    ("kitchen", "IAQ_proxy", "IAQ", "max", "maximum"),
    ("office", "temperature_c", "temperature", "min", "minimum"),
    ("office", "humidity_rh", "humidity", "max", "maximum"),
    ("office", "pressure_hpa", "pressure", "min", "minimum"),
    ("office", "gas_resistance_ohms", "gas resistance", "max", "maximum"),
    ("office", "IAQ_proxy", "IAQ", "max", "maximum"),
]
# Chart questions, chosen round-robin by case position.
CHART_QUESTIONS = [
    "explain the trend",
    "what stands out in this chart",
    "summarize the main pattern",
    "is there any anomaly to note",
    "describe whether the signal looks stable",
]
# Chart rubric per metric.
CHART_RUBRICS = {
    "temperature_c": ["identify the main trend", "note comfort-band crossings if visible", "do not invent values"],
    "humidity_rh": ["identify the main trend", "note low-humidity risk if visible", "do not invent values"],
    "pressure_hpa": ["identify the main trend", "mention major fluctuations only if visible", "do not invent values"],
    "gas_resistance_ohms": ["identify the main trend", "mention spikes or dips if visible", "do not invent values"],
    "IAQ_proxy": ["identify the main trend", "mention notable peaks or drops if visible", "do not invent values"],
}
# Safe-limit question and rubric per banded metric (ablation).
ABLATION_QUESTIONS = {
    "temperature_c": ("Based on this day's temperature observations, did the readings stay within the safe limit "
                      "throughout the entire day? Answer with within safe limit or outside safe limit, then briefly "
                      "explain using the chart."),
    "humidity_rh": ("Based on this day's humidity observations, did the readings stay within the safe limit "
                    "throughout the entire day? Answer with within safe limit or outside safe limit, then briefly "
                    "explain using the chart."),
}
ABLATION_RUBRICS = {
    "temperature_c": ["use the temperature safe range when available",
                      "decide whether the plotted observations stay within the safe limit",
                      "briefly cite visible chart evidence"],
    "humidity_rh": ["use the humidity safe range when available",
                    "decide whether the plotted observations stay within the safe limit",
                    "briefly cite visible chart evidence"],
}
CONDITIONS = ["kg_on", "kg_off"]


def _metrics() -> Column:
    """The five case metrics as literal rows (metric, word, m_ord, rubric)."""
    rows = [(m, w, i, " | ".join(CHART_RUBRICS[m])) for i, (m, w) in enumerate(CASE_METRICS)]
    return fixed_rows(["metric", "word", "m_ord", "rubric"], rows)


def question_cases(iaq: DataFrame) -> DataFrame:
    """G-1: 'average' for every room x metric, plus the listed min/max cases
    for rooms present in the data."""
    spark = iaq.sparkSession
    rooms = iaq.select("location").distinct()
    avg = rooms.select("location", _metrics()).select(
        F.format_string("What is the average %s of %s?", "word", "location").alias("text"),
        "location", "metric", F.lit("mean").alias("agg"))
    mm = spark.createDataFrame(MINMAX_CASES, "location string, metric string, word string, agg string, aw string")
    mm = F.broadcast(mm).join(rooms, "location", "left_semi").select(
        F.format_string("What is the %s %s of %s?", "aw", "word", "location").alias("text"),
        "location", "metric", "agg")
    return avg.unionByName(mm)


def plot_cases(iaq: DataFrame) -> DataFrame:
    """G-3 over the data's days and rooms, numbered in (date, room, metric) order."""
    dr = iaq.select(F.to_date("Date").cast("string").alias("date"), "location").distinct()
    c = dr.select("*", _metrics()).select(
        F.concat_ws(" ", F.lit("plot"), "word", F.lit("for"), "date", F.lit("in"), "location").alias("text"),
        "date", "location", "metric", "m_ord", "rubric",
        F.struct("date", "location", "m_ord").alias("_ord"))
    return index_within_groups(c, [], "_ord", "case_index").drop("_ord")


def chart_cases(iaq: DataFrame) -> DataFrame:
    """G-4: plot cases + round-robin question (position % 5) + rubric."""
    qs = F.array(*[F.lit(q) for q in CHART_QUESTIONS])
    return plot_cases(iaq).withColumn(
        "question", F.element_at(qs, (F.col("case_index") % len(CHART_QUESTIONS) + 1).cast("int")))


def card_cases(iaq: DataFrame) -> DataFrame:
    """G-2: every day x room x banded metric (time carried, never used)."""
    dr = iaq.select(F.to_date("Date").cast("string").alias("date"), "location").distinct()
    return (dr.select("*", fixed_rows(["metric"], [("temperature_c",), ("humidity_rh",)]))
            .withColumn("time", F.lit("08:15")))


def ablation_cases(iaq: DataFrame, banded: DataFrame) -> DataFrame:
    """G-5: plot cases of metrics with a range (F-12 semi join) x conditions,
    numbered from 1 inside each condition."""
    spark = iaq.sparkSession
    qrows = [(m, ABLATION_QUESTIONS[m], " | ".join(ABLATION_RUBRICS[m])) for m in ABLATION_QUESTIONS]
    qd = F.broadcast(spark.createDataFrame(qrows, "metric string, question string, rubric string"))
    dr = iaq.select(F.to_date("Date").cast("string").alias("expected_date"),
                    F.col("location").alias("expected_location")).distinct()
    # `banded` is the metric dimension filtered to metrics with a range: at
    # most five rows, so the semi join is a broadcast.
    c = (dr.select("*", _metrics()).drop("rubric").join(F.broadcast(banded), "metric", "left_semi")
         .join(qd, "metric").select("*", fixed_rows(["condition"], [(x,) for x in CONDITIONS]))
         .select(F.concat_ws(" ", F.lit("plot"), "word", F.lit("for"), "expected_date", F.lit("in"),
                             "expected_location").alias("plot_request"),
                 "question", "rubric", F.col("metric").alias("expected_metric"), "expected_location",
                 "expected_date", "condition", F.struct("expected_date", "expected_location", "m_ord").alias("_ord")))
    idx = index_within_groups(c, ["condition"], "_ord", "index").drop("_ord")
    return idx.withColumn("index", F.col("index") + 1)
