"""Registered evaluation queries: records, grading, predictions, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.functions import text as tx
from roomlens.functions.numeric import stable_round
from roomlens.operators import cases, evaluate as ev, room, sampling
from roomlens.sources import fixtures as fx
from roomlens.sources.tables import read_table

PRED_KEYS = ["run", "model"]
SAMPLE_SEED = 31
SAMPLE_N = 150
# A user's `--rename` argument (folder=label pairs, comma separated).
RENAMES_ARG = "src0_en_latest = Source zero (en),src1_de_latest=Source one (de),junk,=nolabel,src2_fr_latest="


def q_record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summarize_records(fx.records(spark, sf_dir, with_index=False))


def q_console_summary(spark, sf_dir):
    return ev.console_summary(ev.summarize_records(fx.records(spark, sf_dir, with_index=False)))


def q_file_progress(spark, sf_dir):
    return ev.file_counts(fx.records(spark, sf_dir, with_index=False), "order_key")


def q_record_totals(spark, sf_dir):
    # totals need no line index: skip building it
    return ev.grand_totals(ev.file_counts(fx.records(spark, sf_dir, with_index=False)))


def q_first_pending(spark, sf_dir):
    return ev.file_counts(fx.records(spark, sf_dir, with_index=False), "order_key").select("file", "first_pending")


def q_best_worst(spark, sf_dir):
    return ev.best_worst(ev.summarize_records(fx.records(spark, sf_dir, with_index=False)))


def q_kg_gain(spark, sf_dir):
    return ev.kg_gain(fx.records(spark, sf_dir, with_index=False))


def q_paired_outcomes(spark, sf_dir):
    return ev.paired_outcomes(fx.records(spark, sf_dir, with_index=False), F.floor(F.col("order_key") / 2))


def q_review_rows(spark, sf_dir):
    return ev.review_rows(fx.records(spark, sf_dir))


def q_grade_merge(spark, sf_dir):
    recs = fx.records(spark, sf_dir)
    return ev.merge_grades(recs, fx.grades(spark, sf_dir, recs))


def q_grade_rejects(spark, sf_dir):
    recs = fx.records(spark, sf_dir)
    return ev.rejected_grades(recs, fx.grades(spark, sf_dir, recs)).select(
        "file", "index", "correct", F.date_format("graded_at", "yyyy-MM-dd HH:mm:ss").alias("graded_at"))


def _predictions(spark, sf_dir) -> DataFrame:
    return ev.parse_predictions(fx.prediction_inputs(spark, sf_dir))


def q_predict_parse(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.select("run", "model", "image_path", "true_label", "pred_label", "is_correct",
                    stable_round("latency_s", 6).alias("latency_s"))


def q_confusion(spark, sf_dir):
    return ev.confusion(_predictions(spark, sf_dir), PRED_KEYS)


def q_confusion_grid(spark, sf_dir):
    return ev.confusion_grid(_predictions(spark, sf_dir), PRED_KEYS)


def q_class_accuracy(spark, sf_dir):
    return ev.class_accuracy(_predictions(spark, sf_dir), PRED_KEYS)


def q_latency_stats(spark, sf_dir):
    return ev.latency_stats(_predictions(spark, sf_dir), PRED_KEYS)


def q_latency_box(spark, sf_dir):
    return ev.latency_box(_predictions(spark, sf_dir), PRED_KEYS)


def q_metric_long(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return ev.metric_long(ev.prediction_summary(p, PRED_KEYS), PRED_KEYS)


def q_class_sample(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    s = sampling.sample_per_class(docs, "lang", "doc_id", SAMPLE_N, SAMPLE_SEED)
    return s.select(F.col("cls").alias("lang"), "draw", F.col("item").alias("image_path"), "with_replacement")


def renamed(arg: str, name: Column) -> Column:
    """X-14: the label that `folder=label, folder=label` gives a name (the
    last one counts), or NULL; entries with an empty side do not count."""
    pairs = F.transform(F.filter(F.split(F.lit(arg), ","), lambda x: x.contains("=")), lambda x: F.struct(
        tx.strip_ws(F.regexp_extract(x, "(?s)^([^=]*)=(.*)$", 1)).alias("k"),
        tx.strip_ws(F.regexp_extract(x, "(?s)^([^=]*)=(.*)$", 2)).alias("v")))
    fits = F.filter(pairs, lambda e: (e["k"] == name) & (e["k"] != "") & (e["v"] != ""))
    return F.try_element_at(fits, F.lit(-1))["v"]


def q_names_renamed(spark, sf_dir):
    """X-13 + X-14: model folder names from each (source, lang), labelled."""
    docs = read_table(spark, sf_dir, "documents", "source", "lang")
    d = docs.distinct().withColumn("folder", tx.sanitize_name(
        F.concat(F.col("source"), F.lit(":"), F.col("lang"), F.lit("/latest"))))
    label = F.coalesce(renamed(RENAMES_ARG, F.col("folder")),
                       F.replace(F.col("folder"), F.lit("_"), F.lit(":")))
    return d.select("source", "lang", "folder", label.alias("label"))


def q_case_tables(spark, sf_dir):
    iaq = fx.iaq(spark, sf_dir)
    g1 = cases.question_cases(iaq).select(F.lit("nl_sql").alias("task"), "text", "location", "metric", "agg",
                                          F.lit(None).cast("string").alias("date"),
                                          F.lit(None).cast("string").alias("question"),
                                          F.lit(None).cast("string").alias("rubric"))
    g2 = cases.card_cases(iaq).select(F.lit("display_cards").alias("task"),
                                      F.concat_ws(" ", "date", "time", "location").alias("text"),
                                      "location", "metric", F.lit(None).cast("string").alias("agg"), "date",
                                      F.lit(None).cast("string").alias("question"),
                                      F.lit(None).cast("string").alias("rubric"))
    g4 = cases.chart_cases(iaq).select(F.lit("chart_interp").alias("task"), "text", "location", "metric",
                                       F.lit(None).cast("string").alias("agg"), "date", "question", "rubric")
    return g1.unionByName(g2).unionByName(g4)


def q_ablation_cases(spark, sf_dir):
    dim = room.metric_dim(spark)
    banded = dim.where(F.col("has_range")).select("metric")
    return cases.ablation_cases(fx.iaq(spark, sf_dir), banded)


QUERIES = {
    "record_summary": q_record_summary,
    "console_summary": q_console_summary,
    "file_progress": q_file_progress,
    "record_totals": q_record_totals,
    "first_pending": q_first_pending,
    "best_worst": q_best_worst,
    "kg_gain": q_kg_gain,
    "paired_outcomes": q_paired_outcomes,
    "review_rows": q_review_rows,
    "grade_merge": q_grade_merge,
    "grade_rejects": q_grade_rejects,
    "predict_parse": q_predict_parse,
    "confusion": q_confusion,
    "confusion_grid": q_confusion_grid,
    "class_accuracy": q_class_accuracy,
    "latency_stats": q_latency_stats,
    "latency_box": q_latency_box,
    "metric_long": q_metric_long,
    "class_sample": q_class_sample,
    "names_renamed": q_names_renamed,
    "case_tables": q_case_tables,
    "ablation_cases": q_ablation_cases,
}
