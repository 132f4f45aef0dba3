"""Index, order statistics, top-k and sampling vs brute force, with one hot
group holding most rows (the path that must not gather a group in a task)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roomlens.operators.indexing import index_within_groups
from roomlens.operators.quantiles import order_statistics
from roomlens.operators.sampling import manifest, sample_per_class
from roomlens.operators.topk import top_k


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        g = "hot" if i % 3 else rnd.choice(["a", "b", "c", "d"])
        data.append((g, i, round(rnd.uniform(0, 100), 3)))
    return spark.createDataFrame(data, "g string, k long, v double"), data


def test_index_within_groups_matches_row_number(spark, skewed):
    df, _ = skewed
    got = index_within_groups(df, ["g"], "k", "idx", num_partitions=7)
    w = Window.partitionBy("g").orderBy("k")
    exp = df.withColumn("idx", F.row_number().over(w) - 1)
    assert sorted(got.select("g", "k", "idx").collect()) == sorted(exp.select("g", "k", "idx").collect())


def test_index_without_groups(spark, skewed):
    df, data = skewed
    got = index_within_groups(df, [], "k", "idx", num_partitions=5).select("k", "idx").collect()
    assert sorted((r.k, r.idx) for r in got) == [(k, i) for i, k in enumerate(sorted(d[1] for d in data))]


def _nearest_rank(vals, p):
    s = sorted(vals)
    return s[max(math.ceil(round(p * len(s), 9)) - 1, 0)]


def test_order_statistics_vs_numpy(spark, skewed):
    df, data = skewed
    out = order_statistics(df, ["g"], "v", linear={"q1": 0.25, "median": 0.5, "q3": 0.75},
                           nearest_rank={"p95": 0.95}).collect()
    by = {}
    for g, _, v in data:
        by.setdefault(g, []).append(v)
    for r in out:
        vals = by[r.g]
        assert r.n == len(vals)
        assert r.median == pytest.approx(float(np.median(vals)))
        assert r.q1 == pytest.approx(float(np.percentile(vals, 25)))
        assert r.q3 == pytest.approx(float(np.percentile(vals, 75)))
        assert r.p95 == _nearest_rank(vals, 0.95)


@pytest.mark.parametrize("n,rank", [(120, 114), (16, 16), (20, 19), (1, 1)])
def test_p95_nearest_rank_rule(spark, n, rank):
    """trap 3: p95 = value at rank ceil(0.95 n) (1-based)."""
    df = spark.createDataFrame([("m", float(i)) for i in range(1, n + 1)], "g string, v double")
    r = order_statistics(df, ["g"], "v", nearest_rank={"p95": 0.95}).collect()[0]
    assert r.p95 == float(rank)


def test_top_k_exact(spark, skewed):
    df, data = skewed
    got = top_k(df, "g", ["v", "k"], 5, salt_buckets=8, rank_col="r").select("g", "k", "r").collect()
    by = {}
    for g, k, v in data:
        by.setdefault(g, []).append((v, k))
    exp = sorted((g, k, i + 1) for g, lst in by.items() for i, (_, k) in enumerate(sorted(lst)[:5]))
    assert sorted((r.g, r.k, r.r) for r in got) == exp


def test_sample_exact_n_and_reproducible(spark, skewed):
    df, data = skewed
    items = df.select("g", F.col("k").cast("string").alias("item"))
    s1 = sample_per_class(items, "g", "item", 50, seed=31)
    counts = {r.cls: r.c for r in s1.groupBy("cls").agg(F.count("*").alias("c")).collect()}
    assert all(c == 50 for c in counts.values()) and set(counts) == {"hot", "a", "b", "c", "d"}
    # without replacement in full classes: distinct items
    assert s1.where(~F.col("with_replacement")).groupBy("cls").agg(F.countDistinct("item").alias("d")) \
        .where(F.col("d") != 50).count() == 0
    s2 = sample_per_class(items, "g", "item", 50, seed=31)
    assert sorted(s1.collect()) == sorted(s2.collect())
    m = manifest(s1, 31, 50).collect()
    assert all(r.items == sorted(r.items) and len(r.items) == 50 for r in m)


def test_sample_short_class_with_replacement(spark):
    items = spark.createDataFrame([("x", "a"), ("x", "b")] + [("y", str(i)) for i in range(10)],
                                  "cls string, item string")
    s = sample_per_class(items, "cls", "item", 4, seed=1).collect()
    xs = [r for r in s if r.cls == "x"]
    assert len(xs) == 4 and all(r.with_replacement for r in xs) and {r.item for r in xs} <= {"a", "b"}
    assert len([r for r in s if r.cls == "y"]) == 4


def test_broadcast_if_small_both_branches(spark):
    from roomlens.operators.sizing import broadcast_if_small
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # inspect the static plan
    try:
        big = spark.range(20000).withColumn("g", F.col("id") % 5)
        small = spark.range(5).withColumnRenamed("id", "g").withColumn("name", F.concat(F.lit("g"), F.col("g")))
        under = big.join(broadcast_if_small(small), "g")
        over = big.join(broadcast_if_small(small, max_bytes=0), "g")
        assert "BroadcastHashJoin" in under._jdf.queryExecution().executedPlan().toString()
        auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = over._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        assert "SortMergeJoin" in plan
        assert under.count() == over.count() == 20000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_spread_deals_rows_out_only_when_asked(spark):
    from roomlens.sources.tables import spread
    one = spark.range(0, 1000, numPartitions=1)
    spark.conf.set("roomlens.textPartitions", "3")
    assert spread(one).rdd.getNumPartitions() == 3
    assert sorted(r.id for r in spread(one).collect()) == list(range(1000))
    spark.conf.unset("roomlens.textPartitions")
    assert spread(one) is one


def test_measured_size_counts_nested_values(spark):
    from roomlens.operators.sizing import _row_bytes
    df = spark.createDataFrame([([1] * 1000, {"a": 1}, ("x" * 500,)), (None, None, None)],
                               "a array<int>, m map<string,int>, s struct<t:string>")
    big, none = (r.b for r in df.select(_row_bytes(df).alias("b")).collect())
    assert big > 4500 and 0 < none < 100


def test_large_tables_are_not_broadcast(spark):
    from roomlens.operators.sizing import broadcast_if_small
    df = spark.range(1000).selectExpr("id", "array_repeat(id, 50) as a")
    plan = lambda most: spark.range(5).join(broadcast_if_small(df, most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(10_000_000) and "broadcast" not in plan(10_000)
