"""A-9..A-17 and J-7 on hand-made records and predictions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roomlens.operators import evaluate as ev


@pytest.fixture(scope="module")
def preds(spark):
    rows = [
        # (model, true, text, latency)
        ("m1", "SAFE", "It looks safe", 1.0), ("m1", "SAFE", "unsafe!", 2.0), ("m1", "SAFE", "", 3.0),
        ("m1", "UNSAFE", "danger", 4.0), ("m1", "UNSAFE", "safe", 5.0),
        ("m2", "UNSAFE", "smoke seen", 1.5), ("m2", "UNSAFE", "fire", None),
    ]
    df = spark.createDataFrame(rows, "model string, true_label string, model_text string, latency_s double")
    return ev.parse_predictions(df)


def test_confusion_definitions(spark, preds):
    c = {r.model: (r.tp, r.tn, r.fp, r.fn) for r in ev.confusion(preds, ["model"]).collect()}
    # FN counts SAFE predicted as anything else, UNKNOWN included
    assert c["m1"] == (1, 1, 1, 2)
    assert c["m2"] == (0, 2, 0, 0)
    # invariant: tp + fn = number of true SAFE
    assert c["m1"][0] + c["m1"][3] == 3


def test_class_accuracy_empty_class_is_zero(spark, preds):
    a = {r.model: r for r in ev.class_accuracy(preds, ["model"]).collect()}
    assert a["m1"].accuracy == pytest.approx(2 / 5)
    assert a["m1"].safe_accuracy == pytest.approx(1 / 3)
    assert a["m1"].unsafe_accuracy == pytest.approx(1 / 2)
    assert a["m2"].safe_accuracy == 0.0 and a["m2"].unsafe_accuracy == 1.0


def test_latency_stats(spark, preds):
    s = {r.model: r for r in ev.latency_stats(preds, ["model"]).collect()}
    assert (s["m1"].latency_mean_s, s["m1"].latency_min_s, s["m1"].latency_max_s) == (3.0, 1.0, 5.0)
    assert s["m1"].latency_median_s == 3.0 and s["m1"].latency_p95_s == 5.0
    assert s["m2"].n == 1 and s["m2"].latency_median_s == 1.5


def test_latency_box_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("m", v) for v in vals], "model string, latency_s double")
    b = ev.latency_box(df, ["model"]).collect()[0]
    assert (b.q1, b.median, b.q3) == (2.0, 3.0, 4.0)
    assert b.whisker_low == 1.0 and b.whisker_high == 4.0     # 100 is a flier (> q3 + 1.5 iqr)


def _records(spark):
    rows = [("f1", 0, "", "nl_sql", None, True, "1.0"), ("f1", 1, "a", "nl_sql", None, False, "2.0"),
            ("f1", 2, "a", "nl_sql", None, None, None), ("f2", 0, "a", "kg_ablation", "kg_on", True, "bad"),
            ("f2", 1, "a", "kg_ablation", "kg_off", None, "3.0")]
    return spark.createDataFrame(rows, "file string, index long, model string, task string, condition string, "
                                       "correct boolean, latency_s string") \
        .withColumn("latency_total_s", F.lit(None).cast("string")) \
        .withColumn("latency_interp_s", F.lit(None).cast("string")) \
        .withColumn("latency_plot_s", F.lit(None).cast("string")) \
        .withColumn("order_key", F.col("index"))


def test_record_summary_invariants(spark):
    s = ev.summarize_records(_records(spark)).collect()
    by = {(r.model, r.task): r for r in s}
    assert by[("default", "nl_sql")].total == 1 and by[("default", "nl_sql")].accuracy == 1.0
    a = by[("a", "nl_sql")]
    assert (a.correct, a.graded, a.pending, a.total) == (0, 1, 1, 2)
    assert a.mean_latency_s == 2.0
    assert by[("a", "kg_ablation [kg_on]")].mean_latency_s is None     # unparseable latency
    for r in s:
        assert r.graded + r.pending == r.total


def test_merge_grades_last_wins_and_rejects(spark):
    recs = _records(spark)
    grades = spark.createDataFrame([
        ("f1", 2, True, " first ", dt.datetime(2024, 1, 1, 10)),
        ("f1", 2, False, "  ", dt.datetime(2024, 1, 1, 11)),      # later grade wins; blank note removed
        ("f1", 9, True, "x", dt.datetime(2024, 1, 1, 12)),        # out of range -> rejected
    ], "file string, index long, correct boolean, note string, graded_at timestamp_ntz")
    merged, rejected = ev.merge_grades(recs, grades), ev.rejected_grades(recs, grades)
    m = {(r.file, r["index"]): r for r in merged.collect()}
    assert m[("f1", 2)].correct is False and m[("f1", 2)].note is None
    assert m[("f1", 2)].graded_at == "2024-01-01T11:00:00+00:00"
    assert m[("f1", 0)].correct is True and m[("f1", 0)].graded_at is None
    assert [(r.file, r["index"]) for r in rejected.collect()] == [("f1", 9)]
    assert merged.count() == recs.count()


def test_confusion_grid_layout(spark, preds):
    """A-18: [[tp, fn], [fp, tn]], both rows present even for an empty class."""
    g = {(r.model, r.true_label): (r.pred_safe, r.pred_unsafe)
         for r in ev.confusion_grid(preds, ["model"]).collect()}
    assert g[("m1", "SAFE")] == (1, 2) and g[("m1", "UNSAFE")] == (1, 1)
    assert g[("m2", "SAFE")] == (0, 0) and g[("m2", "UNSAFE")] == (0, 2)


def test_prediction_summary_matches_separate_operators(spark, preds):
    """J-8 in one pass equals A-14, A-15 and A-16 computed separately."""
    one = {r.model: r.asDict() for r in ev.prediction_summary(preds, ["model"]).collect()}
    acc = {r.model: r.asDict() for r in ev.class_accuracy(preds, ["model"]).collect()}
    conf = {r.model: r.asDict() for r in ev.confusion(preds, ["model"]).collect()}
    lat = {r.model: r.asDict() for r in ev.latency_stats(preds, ["model"]).collect()}
    for m in one:
        for src in (acc[m], conf[m], lat[m]):
            for k, v in src.items():
                if k in one[m]:
                    assert one[m][k] == v, (m, k)


def test_whiskers_never_inside_the_box_and_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 100.0), ("b", None)], "g string, latency_s double")
    box = {r.g: r for r in ev.latency_box(df, ["g"]).collect()}
    assert (box["a"].q3, box["a"].whisker_low, box["a"].whisker_high) == (25.75, 1.0, 25.75)
    assert box["b"].n == 0 and box["b"].q1 is None
    stats = {r.g: r for r in ev.latency_stats(df, ["g"]).collect()}
    assert stats["a"].n == 4 and stats["a"].latency_p95_s == 100.0 and stats["b"].n == 0


def test_pairs_are_per_model_and_ungraded_is_not_unpaired(spark):
    rows = [("m1", "kg_on", True), ("m1", "kg_off", False), ("m2", "kg_on", False), ("m2", "kg_off", True),
            ("m3", "kg_on", True), ("m4", "kg_on", None), ("m4", "kg_off", True)]
    df = spark.createDataFrame([(m, c, x, 1) for m, c, x in rows], "model string, condition string, correct boolean, k int")
    got = {r.model: r.outcome for r in ev.paired_outcomes(df, df.k).collect()}
    assert got == {"m1": "kg_on_only", "m2": "kg_off_only", "m3": "unpaired", "m4": "ungraded"}


def test_first_pending_without_a_sort(spark):
    rows = [("f", k, k != 30) for k in (10, 20, 30, 40)] + [("g", 5, True)]
    df = spark.createDataFrame([(f, k, True if c else None) for f, k, c in rows], "file string, order_key long, correct boolean")
    assert {r.file: r.first_pending for r in ev.file_counts(df, "order_key").collect()} == {"f": 2, "g": 0}
