"""F-8/F-9 guarded SQL and T-1 streaming summary == batch summary."""

import json

import pytest
from pyspark.sql import functions as F

from roomlens.operators import evaluate as ev
from roomlens.operators.sqlguard import UnsafeSQL, check_sql, guarded_sql
from roomlens.session import scratch_path
from roomlens.streaming.summary import summary_stream


@pytest.mark.parametrize("sql", ["drop table iaq", "select 1; delete from iaq", "SHOW TABLES",
                                 "select java_method('java.lang.System','exit',0)",
                                 "select * from iaq where updated_at > 0"])
def test_guard_rejects(sql):
    with pytest.raises(UnsafeSQL):
        check_sql(sql)


def test_guarded_sql_runs_on_view(spark):
    df = spark.createDataFrame([("kitchen", 1.0), ("kitchen", 3.0), ("office", 5.0)], "location string, v double")
    out = guarded_sql(spark, "  select location, avg(v) as m from iaq group by location", {"iaq": df})
    assert sorted(tuple(r) for r in out.collect()) == [("kitchen", 2.0), ("office", 5.0)]
    # SQL on files is refused at analysis
    with pytest.raises(Exception):
        guarded_sql(spark, "select * from parquet.`/root/testdata/sf0.001/region.parquet`", {}).collect()


RECORD_FIELDS = ["model", "task", "condition", "correct", "latency_s", "latency_total_s",
                 "latency_interp_s", "latency_plot_s"]


def test_stream_summary_equals_batch(spark, tmp_path):
    src = tmp_path / "records"
    src.mkdir()
    recs = []
    for f in range(4):
        batch = []
        for i in range(25):
            k = f * 25 + i
            batch.append({"model": ["m1", "m2", ""][k % 3], "task": ["nl_sql", "kg_ablation"][k % 2],
                          "condition": "kg_on" if k % 2 else None,
                          "correct": None if k % 5 == 0 else bool(k % 3), "latency_s": str(k / 10),
                          "latency_total_s": None, "latency_interp_s": None, "latency_plot_s": None})
        recs += batch
        with open(src / f"part-{f}.jsonl", "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in batch) + "\n\n")
    schema = ("model string, task string, condition string, correct boolean, latency_s string, "
              "latency_total_s string, latency_interp_s string, latency_plot_s string")
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    streamed = summary_stream(spark, str(src), st, scratch_path(spark, "t1-ckpt"), "t1_summary", max_files=1)
    batch = ev.summarize_records(spark.read.schema(st).json(str(src)))
    key = lambda r: (r.model, r.task)
    assert sorted(map(tuple, streamed.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert sum(r.total for r in batch.collect()) == len(recs)


def test_stream_summary_resumes_from_checkpoint(spark, tmp_path):
    """A restarted query keeps its aggregation state from the checkpoint:
    files seen before the restart are not counted again."""
    from pyspark.sql.types import _parse_datatype_string
    schema = ("model string, task string, condition string, correct boolean, latency_s string, "
              "latency_total_s string, latency_interp_s string, latency_plot_s string")
    st = _parse_datatype_string(schema)
    src = tmp_path / "src"
    src.mkdir()

    def write(part, keys):
        rows = [{"model": ["m1", "m2"][k % 2], "task": "nl_sql", "condition": None,
                 "correct": None if k % 3 == 0 else bool(k % 2), "latency_s": str(k),
                 "latency_total_s": None, "latency_interp_s": None, "latency_plot_s": None} for k in keys]
        (src / f"part-{part}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")

    ckpt = scratch_path(spark, "t1-restart")
    write(0, range(0, 30))
    first = summary_stream(spark, str(src), st, ckpt, "t1_first", max_files=1)
    assert sum(r.total for r in first.collect()) == 30
    write(1, range(30, 50))
    second = summary_stream(spark, str(src), st, ckpt, "t1_second", max_files=1)
    batch = ev.summarize_records(spark.read.schema(st).json(str(src)))
    assert sorted(map(tuple, second.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert sum(r.total for r in second.collect()) == 50


def test_live_summary_refreshes(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string
    from roomlens.streaming.summary import live_summary
    st = _parse_datatype_string("model string, task string, condition string, correct boolean, latency_s string, "
                                "latency_total_s string, latency_interp_s string, latency_plot_s string")
    src = tmp_path / "live"
    src.mkdir()

    def write(part, n):
        rows = [{"model": "m", "task": "nl_sql", "correct": bool(k % 2), "latency_s": "1"} for k in range(n)]
        (src / f"p{part}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")

    write(0, 4)
    q = live_summary(spark, str(src), st, scratch_path(spark, "live-ckpt"), "t1_live", every_seconds=1)
    try:
        q.processAllAvailable()
        assert spark.table("t1_live").collect()[0].total == 4
        write(1, 6)
        q.processAllAvailable()
        assert spark.table("t1_live").collect()[0].total == 10
    finally:
        q.stop()


@pytest.mark.parametrize("sql", ["select transform(location) using 'cat' as (x string) from iaq",
                                 "select * from (select map(a) USING 'cat' from iaq)", "select 1 from t reduce a\nusing\n'x'"])
def test_guard_refuses_script_transformation(spark, sql):
    with pytest.raises(UnsafeSQL):
        check_sql(sql)
    df = spark.createDataFrame([(sql,), (None,)], "s string")
    from roomlens.functions.text import guard_reason
    assert all(r.g for r in df.select(guard_reason(df.s).alias("g")).collect())


def test_guard_lets_joins_and_lambdas_pass():
    check_sql("select transform(a, x -> x + 1) from t join u using (k)")
