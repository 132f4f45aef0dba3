"""Evaluation operators: record summaries, grading, prediction scoring.

All group-bys here are plain hash aggregates with map-side partial
aggregation, so a hot model/task key (a third of all records) contributes
one partial row per map task.  Windows are only used over groups whose size
is bounded by construction (grades per record, summary rows per task);
exact order statistics go through ``operators.quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlens.functions import text as tx
from roomlens.functions.numeric import stable_round
from roomlens.operators.quantiles import order_statistics
from roomlens.operators.sizing import broadcast_if_small


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


# ---------------------------------------------------------------- A-9, A-10
def summarize_records(recs: DataFrame) -> DataFrame:
    """A-9: per (model or `default`, task label): correct, graded, pending,
    total, accuracy (NULL when nothing graded), mean latency (NULL if none)."""
    keyed = recs.select(
        F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("default")).alias("model"),
        tx.task_label(F.col("task"), F.col("condition")).alias("task"),
        "correct", tx.record_latency().alias("_lat"))
    agg = keyed.groupBy("model", "task").agg(
        count_if(F.col("correct") == F.lit(True)).alias("correct"),
        count_if(F.col("correct").isNotNull()).alias("graded"),
        count_if(F.col("correct").isNull()).alias("pending"),
        F.count(F.lit(1)).alias("total"),
        F.avg("_lat").alias("_mean_lat"))
    return agg.select("model", "task", "correct", "graded", "pending", "total",
                      stable_round(F.try_divide(F.col("correct"), F.col("graded")), 6).alias("accuracy"),
                      stable_round("_mean_lat", 6).alias("mean_latency_s"))


def console_summary(summary: DataFrame) -> DataFrame:
    """A-10: the printed table's cells (`%.1f%%` / `-`, `%.3f` / `-`)."""
    return summary.select(
        "model", "task", F.col("total").alias("n"), "correct", "pending",
        F.when(F.col("accuracy").isNotNull(),
               F.format_string("%.1f%%", stable_round(F.col("accuracy") * 100, 1))).otherwise("-").alias("accuracy"),
        F.when(F.col("mean_latency_s").isNotNull(),
               F.format_string("%.3f", stable_round("mean_latency_s", 3))).otherwise("-").alias("mean_latency"))


# ---------------------------------------------------------- A-11..A-13, A-21
def file_counts(recs: DataFrame, order_col: str | None = None, modified_col: str | None = None) -> DataFrame:
    """A-11 + A-13 + A-21 per result file.  `first_pending` (A-21) is the
    position of the first ungraded record in `order_col` order: the number of
    the file's records before it.  Two partial aggregates, no sort.
    `updated_at` is the latest `modified_col` of the file's rows."""
    aggs = [F.count(F.lit(1)).alias("total"),
            count_if(F.col("correct").isNotNull()).alias("graded"),
            count_if(F.col("correct") == F.lit(True)).alias("correct")]
    if order_col:
        aggs.append(F.min(F.when(F.col("correct").isNull(), F.col(order_col))).alias("_least"))
    if modified_col:
        aggs.append(F.max(modified_col).alias("updated_at"))
    agg = recs.groupBy("file").agg(*aggs)
    cols = ["file", tx.task_type_for_file(F.col("file")).alias("task_type"), "total", "graded",
            (F.col("total") - F.col("graded")).alias("pending"), "correct",
            F.when(F.col("total") > 0, F.round(F.col("graded") * 100 / F.col("total"), 0).cast("long"))
             .otherwise(F.lit(0)).alias("progress_pct")]
    if order_col:
        # one row per file: broadcast behind its measured size
        agg = broadcast_if_small(agg)
        before = recs.join(agg.select("file", "_least"), "file").where(F.col(order_col) < F.col("_least")) \
            .groupBy("file").agg(F.count(F.lit(1)).alias("_before"))
        agg = agg.join(before, "file", "left")
        cols.append(F.coalesce("_before", F.lit(0).cast("long")).alias("first_pending"))
    return agg.select(*cols, *(["updated_at"] if modified_col else []))


def grand_totals(files: DataFrame) -> DataFrame:
    """A-12."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("total").alias("records"),
                     F.sum("graded").alias("graded")) \
        .select("files", "records", "graded",
                F.greatest(F.col("records") - F.col("graded"), F.lit(0)).alias("pending"))


# ---------------------------------------------------------------------- W-1
def best_worst(summary: DataFrame) -> DataFrame:
    """W-1: per task, best = max accuracy, worst = min; a tie counts as best."""
    ext = summary.groupBy("task").agg(F.max("accuracy").alias("_best"), F.min("accuracy").alias("_worst"))
    j = summary.join(ext, "task")
    hl = (F.when(F.col("accuracy").isNull(), F.lit(None).cast("string"))
          .when(F.col("accuracy") == F.col("_best"), "best")
          .when(F.col("accuracy") == F.col("_worst"), "worst"))
    return j.select("task", "model", "accuracy", hl.alias("highlight"))


# ------------------------------------------------------------- A-19, A-20
def kg_gain(recs: DataFrame) -> DataFrame:
    """A-19: accuracy(kg_on) - accuracy(kg_off) per model over graded records."""
    r = recs.where(F.col("condition").isin("kg_on", "kg_off")).select(
        F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("default")).alias("model"), "condition", "correct")
    p = (r.groupBy("model").pivot("condition", ["kg_on", "kg_off"])
         .agg(F.try_divide(count_if(F.col("correct") == F.lit(True)),
                           count_if(F.col("correct").isNotNull())).alias("acc")))
    return p.select("model", stable_round("kg_on", 6).alias("acc_kg_on"),
                    stable_round("kg_off", 6).alias("acc_kg_off"),
                    stable_round(F.col("kg_on") - F.col("kg_off"), 6).alias("kg_gain"))


def paired_outcomes(recs: DataFrame, pair_col: Column) -> DataFrame:
    """A-20: outcome of each case of a model under both conditions.  A pair
    that lacks a condition is `unpaired`; one that has both, but not both
    graded, is `ungraded`."""
    r = recs.where(F.col("condition").isin("kg_on", "kg_off")).select(
        F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("default")).alias("model"),
        pair_col.alias("pair_id"), "condition", F.col("correct").cast("int").alias("c"))
    p = r.groupBy("model", "pair_id").pivot("condition", ["kg_on", "kg_off"]).agg(
        F.max("c").alias("c"), F.count(F.lit(1)).alias("n"))
    on, off = F.col("kg_on_c"), F.col("kg_off_c")
    outcome = (F.when((F.coalesce("kg_on_n", F.lit(0)) == 0) | (F.coalesce("kg_off_n", F.lit(0)) == 0), "unpaired")
               .when(on.isNull() | off.isNull(), "ungraded")
               .when((on == 1) & (off == 1), "both_correct").when(on == 1, "kg_on_only")
               .when(off == 1, "kg_off_only").otherwise("neither"))
    return p.select("model", "pair_id", (on == 1).alias("kg_on_correct"), (off == 1).alias("kg_off_correct"),
                    outcome.alias("outcome"))


# ---------------------------------------------------------------------- X-16
def _js_number(v: Column) -> Column:
    """A JS-style number as text: integral values without a fraction."""
    return F.when(v == F.floor(v), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))


def secondary_prompt(recs: DataFrame) -> Column:
    """The review panel's lines below the prompt, from the columns that there
    are; an empty text where a record has none of them."""
    def col(c: str) -> Column:
        return F.col(c) if c in recs.columns else F.lit(None)

    def span(name: str, a: str, b: str) -> Column:
        return F.when(col(a).isNotNull() | col(b).isNotNull(), F.concat(
            F.lit(f"{name}: "), F.coalesce(_js_number(col(a).cast("double")), F.lit("-")), F.lit(" to "),
            F.coalesce(_js_number(col(b).cast("double")), F.lit("-"))))

    def text(name: str, c: str) -> Column:
        return F.concat(F.lit(name), F.nullif(col(c).cast("string"), F.lit("")))
    both = F.when(F.nullif(col("question").cast("string"), F.lit("")).isNotNull(), text("Plot request: ", "plot_request"))
    return F.concat_ws("\n", text("Expected safe decision: ", "expected_safe_state"),
                       span("KG safe range", "recommended_min", "recommended_max"),
                       span("Observed range", "observed_min", "observed_max"), text("Violation: ", "violation"), both,
                       text("Generated SQL:\n", "generated_sql"))


def review_rows(recs: DataFrame) -> DataFrame:
    """X-16: the review panel's prompt, the lines below it, response, status and condition text."""
    qp = F.col("query_params")
    params = F.when(qp.isNotNull(), F.concat(
        F.lit("date="), F.coalesce(qp["date"], F.lit("undefined")),
        F.lit("\nlocation="), F.coalesce(qp["location"], F.lit("undefined")),
        F.lit("\ntime="), F.coalesce(qp["time"], F.lit("undefined")),
        F.lit("\nmetric="), F.coalesce(qp["metric"], F.lit("undefined"))))
    prompt = F.coalesce(F.nullif(F.col("question"), F.lit("")), F.nullif(F.col("request_text"), F.lit("")),
                        F.nullif(F.col("plot_request"), F.lit("")), params, F.lit("No prompt text recorded."))
    returned = F.when(F.nullif(F.col("returned_state"), F.lit("")).isNotNull() | F.col("returned_value").isNotNull(),
                      F.concat(F.lit("Returned value: "), F.coalesce(_js_number(F.col("returned_value")), F.lit("-")),
                               F.lit("\nReturned state: "), F.coalesce(F.col("returned_state"), F.lit("-"))))
    response = F.coalesce(F.nullif(F.col("model_response"), F.lit("")), F.nullif(F.col("generated_sql"), F.lit("")),
                          returned, F.lit("No model response stored for this record."))
    status = (F.when(F.col("correct") == F.lit(True), "Correct")
              .when(F.col("correct") == F.lit(False), "Incorrect").otherwise("Pending"))
    cond = F.when(F.col("condition") == "kg_off", "KG-Off").otherwise("KG-On")
    return recs.select("file", "index", prompt.alias("prompt"), secondary_prompt(recs).alias("secondary"), response.alias("response"),
                       status.alias("status"), cond.alias("condition_label"))


# ----------------------------------------------------------------- J-7, W-4
def last_grades(grades: DataFrame) -> DataFrame:
    """W-4 as an aggregate: (file, index, g), g being the greatest (graded_at,
    then every other column); groups are bounded by grades per record and
    combine map-side."""
    return grades.groupBy("file", "index").agg(F.max(F.struct("graded_at", "correct", "note")).alias("g"))


def apply_grades(recs: DataFrame, last: DataFrame) -> DataFrame:
    """All columns of the records with `correct`, `note` and `graded_at` of
    their last grade.  The note is trimmed, and NULL if empty; a record
    without a new grade keeps what an earlier grading gave it."""
    def own(c: str) -> Column:
        return F.col(c) if c in recs.columns else F.lit(None).cast("string")

    new = F.col("g").isNotNull()
    put = {"correct": F.when(new, F.col("g.correct")).otherwise(F.col("correct")),
           "note": F.when(new, F.nullif(tx.strip_ws(F.col("g.note")), F.lit(""))).otherwise(own("note")),
           "graded_at": F.when(new, F.date_format("g.graded_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(own("graded_at"))}
    keep = [c for c in recs.columns if c not in put]
    return recs.join(last, ["file", "index"], "left").select(*keep, *[c.alias(n) for n, c in put.items()])


def rejected_grades(recs: DataFrame, grades: DataFrame) -> DataFrame:
    """Grades whose file is unknown or whose index is outside [0, total) of
    it, by the files' record counts (one row per file)."""
    totals = broadcast_if_small(recs.groupBy("file").agg(F.count(F.lit(1)).alias("_total")))
    return grades.join(totals, "file", "left").where(
        F.col("_total").isNull() | F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("_total"))).drop("_total")


def merge_grades(recs: DataFrame, grades: DataFrame) -> DataFrame:
    """J-7: the last grade per (file, index) applied to the records; grades
    outside the files change nothing (`rejected_grades` has them)."""
    return apply_grades(recs, last_grades(grades)).select("file", "index", "order_key", "correct", "note", "graded_at")


# ------------------------------------------------------------- predictions
def parse_predictions(pred: DataFrame) -> DataFrame:
    """X-6/X-7 + is_correct."""
    p = tx.parse_prediction(pred, "model_text", "pred_label")
    return p.withColumn("is_correct", F.col("pred_label") == F.col("true_label"))


def confusion(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A-14 (positive class SAFE; anything not SAFE/UNSAFE counts against)."""
    t, p = F.col("true_label"), F.col("pred_label")
    return pred.groupBy(*keys).agg(
        count_if((t == "SAFE") & (p == "SAFE")).alias("tp"),
        count_if((t == "UNSAFE") & (p == "UNSAFE")).alias("tn"),
        count_if((t == "UNSAFE") & (p != "UNSAFE")).alias("fp"),
        count_if((t == "SAFE") & (p != "SAFE")).alias("fn"))


def confusion_grid(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A-18: the 2x2 matrix as rows (true class) x columns (predicted class),
    laid out [[tp, fn], [fp, tn]]; a prediction that is not the true class
    (UNKNOWN included) counts in the other column.  Unfolded from the A-14
    counts, so every key has both rows even when a class is empty."""
    c = confusion(pred, keys)
    cells = F.array(F.struct(F.lit("SAFE").alias("true_label"), F.col("tp").alias("pred_safe"),
                             F.col("fn").alias("pred_unsafe")),
                    F.struct(F.lit("UNSAFE").alias("true_label"), F.col("fp").alias("pred_safe"),
                             F.col("tn").alias("pred_unsafe")))
    return c.select(*keys, F.inline(cells))


def class_accuracy(pred: DataFrame, keys: list[str]) -> DataFrame:
    """A-15: overall and per-class accuracy, 0.0 for an empty class."""
    t, p = F.col("true_label"), F.col("pred_label")
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("is_correct")).alias("correct"),
        count_if(t == "SAFE").alias("safe_total"), count_if(t == "UNSAFE").alias("unsafe_total"),
        count_if((t == "SAFE") & (p == "SAFE")).alias("safe_correct"),
        count_if((t == "UNSAFE") & (p == "UNSAFE")).alias("unsafe_correct"))

    def ratio(a: str, b: str) -> Column:
        return stable_round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)

    return agg.select(*keys, "total", "correct", ratio("correct", "total").alias("accuracy"),
                      ratio("safe_correct", "safe_total").alias("safe_accuracy"),
                      ratio("unsafe_correct", "unsafe_total").alias("unsafe_accuracy"))


def latency_stats(pred: DataFrame, keys: list[str], value: str = "latency_s") -> DataFrame:
    """A-16: mean/min/max from one aggregate; median (mid-point) and p95
    (nearest rank) from the distributed order statistics.  A group without
    latencies stays, with NULL figures and n = 0."""
    basic = pred.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"),
                                    F.max(value).alias("max"))
    q = order_statistics(pred, keys, value, linear={"median": 0.5}, nearest_rank={"p95": 0.95})
    j = basic.join(q, keys, "left")
    return j.select(*keys, "n", *[stable_round(c, 6).alias(f"latency_{c}_s")
                                  for c in ("mean", "min", "max", "median", "p95")])


# A KLL sketch of this size is off by at most this share of the ranks, with
# 99 % confidence for any one quantile.
SKETCH_K, SKETCH_ERROR = 400, 0.0083


def latency_sketches(pred: DataFrame, keys: list[str], value: str = "latency_s") -> DataFrame:
    """A-16 at scale: a mergeable quantile sketch per key, some hundreds of
    values whatever the group's size.  Rows of it can be stored (per day, say)
    and merged later; NULL and NaN latencies do not count, a group without any
    gives a NULL sketch."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return pred.groupBy(*keys).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, SKETCH_K).alias("sketch")) \
        .withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def sketched_quantiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(keys, n, one column per quantile) of stored sketches merged by the
    coarser ``keys``; each is a value whose rank is within SKETCH_ERROR of the
    asked one.  Up to about SKETCH_K values it is exact (nearest rank)."""
    merged = sketches.where(F.col("sketch").isNotNull()).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(c) for c, q in quantiles.items()])


def rank_spans(pred: DataFrame, estimates: DataFrame, keys: list[str], names: list[str], value: str = "latency_s") -> DataFrame:
    """Where estimates stand in the data: (keys, n, and for each name `below`
    and `upto`, the shares of the group's values under and up to it)."""
    joined = pred.join(broadcast_if_small(estimates.select(*keys, *names)), keys)
    v = F.col(value).cast("double")
    return joined.where(~F.isnan(v)).groupBy(*keys).agg(F.count(v).alias("n"), *[x for c in names for x in (
        (count_if(v < F.col(c)) / F.count(v)).alias(f"{c}_below"), (count_if(v <= F.col(c)) / F.count(v)).alias(f"{c}_upto"))])


def latency_box(pred: DataFrame, keys: list[str], value: str = "latency_s") -> DataFrame:
    """A-17: quartiles (linear), whiskers at the furthest values inside
    1.5 IQR of the box, never inside the box; fliers not reported.  A group
    without latencies stays, with NULL figures and n = 0."""
    q = order_statistics(pred, keys, value, linear={"q1": 0.25, "median": 0.5, "q3": 0.75})
    # one row per group: broadcast behind its measured size, so the values
    # are not shuffled by group to find the whiskers
    q = broadcast_if_small(q.withColumn("iqr", F.col("q3") - F.col("q1")))
    j = pred.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).join(q, keys)
    lo_f, hi_f = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    w = j.groupBy(*keys).agg(F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("low"),
                             F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("high"))
    out = q.join(w, keys, "left").withColumn("whisker_low", F.least("low", "q1")) \
        .withColumn("whisker_high", F.greatest("high", "q3"))
    return out.select(*keys, "n", *[stable_round(c, 6).alias(c)
                                    for c in ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")])


def prediction_summary(pred: DataFrame, keys: list[str], value: str = "latency_s") -> DataFrame:
    """J-8: one row per key with A-14, A-15 and A-16 from a single grouped
    aggregate (partial on the map side) over the parsed predictions; only
    the median and p95 come from the order statistics and are joined by key
    (one row per key on each side)."""
    t, p = F.col("true_label"), F.col("pred_label")
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("is_correct")).alias("correct"),
        count_if(t == "SAFE").alias("safe_total"), count_if(t == "UNSAFE").alias("unsafe_total"),
        count_if((t == "SAFE") & (p == "SAFE")).alias("tp"),
        count_if((t == "UNSAFE") & (p == "UNSAFE")).alias("tn"),
        count_if((t == "UNSAFE") & (p != "UNSAFE")).alias("fp"),
        count_if((t == "SAFE") & (p != "SAFE")).alias("fn"),
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = order_statistics(pred, keys, value, linear={"median": 0.5}, nearest_rank={"p95": 0.95})

    def ratio(a: str, b: str) -> Column:
        return stable_round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)

    return agg.join(q.select(*keys, "median", "p95"), keys, "left").select(
        *keys, "total", "correct", ratio("correct", "total").alias("accuracy"),
        ratio("tp", "safe_total").alias("safe_accuracy"), ratio("tn", "unsafe_total").alias("unsafe_accuracy"),
        "tp", "tn", "fp", "fn",
        *[stable_round(c, 6).alias(f"latency_{c}_s") for c in ("mean", "min", "max", "median", "p95")])


# Summary rows of the published metric table, in order (S-19).
METRIC_ROWS = [
    ("Accuracy", "accuracy"), ("Safe Accuracy", "safe_accuracy"), ("Unsafe Accuracy", "unsafe_accuracy"),
    ("TP", "tp"), ("TN", "tn"), ("FP", "fp"), ("FN", "fn"),
    ("Latency Mean (s)", "latency_mean_s"), ("Latency Median (s)", "latency_median_s"),
    ("Latency P95 (s)", "latency_p95_s"),
]


def metric_long(summary: DataFrame, keys: list[str]) -> DataFrame:
    """S-19: the summary row as (ordinal, metric, text) rows; floats `%.4f`."""
    ints = {"tp", "tn", "fp", "fn"}
    items = []
    for i, (label, col) in enumerate(METRIC_ROWS, start=1):
        txt = (F.col(col).cast("string") if col in ints
               else F.format_string("%.4f", stable_round(F.col(col), 4)))
        items.append(F.struct(F.lit(i).alias("ord"), F.lit(label).alias("metric"), txt.alias("value")))
    return summary.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")
