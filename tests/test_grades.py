"""Grades: result files rewritten in place (J-7), live summary with retraction (T-1)."""

import datetime as dt
import hashlib
import json
import os

import pytest

from roomlens.operators import evaluate as ev
from roomlens.sources import result_files as rf
from roomlens.streaming import grades as sg

REC = ("file string, index long, order_key long, model string, task string, condition string, correct boolean, "
       "latency_total_s string, latency_s string, latency_interp_s string, latency_plot_s string")
T0 = dt.datetime(2024, 3, 1, 12, 0)


def _records(files=3, each=7):
    return [(f"nl_sql_{f}.jsonl", i, 100 * f + i, ["m1", "m2", ""][i % 3], "nl_sql", "kg_on" if f else None,
             [True, False, None][(i + f) % 3], None, ["1.25", "bad", None, "0.1"][i % 4], None, None)
            for f in range(files) for i in range(each)]


def _grades(spark, rows):
    return spark.createDataFrame([(f, i, c, n, T0 + dt.timedelta(minutes=m)) for f, i, c, n, m in rows], sg.GRADE_SCHEMA)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _digests(path):
    return {f: hashlib.sha256(b"".join(open(os.path.join(path, f, p), "rb").read() for p in sorted(os.listdir(os.path.join(path, f)))
                                       if p.startswith("part-"))).hexdigest() for f in os.listdir(path) if f.startswith("file=")}


# ------------------------------------------------------------------------ J-7
def test_merge_keeps_earlier_notes(spark):
    recs = spark.createDataFrame([("a", 0, 1, None, "old", "2024-01-01T00:00:00+00:00"), ("a", 1, 2, True, "old", "x")],
                                 "file string, index long, order_key long, correct boolean, note string, graded_at string")
    got = _rows(ev.merge_grades(recs, _grades(spark, [("a", 1, False, "  ", 0)])))
    assert got == [("a", 0, 1, None, "old", "2024-01-01T00:00:00+00:00"), ("a", 1, 2, False, None, "2024-03-01T12:00:00+00:00")]


def test_two_gradings_of_result_files(spark, tmp_path):
    path = str(tmp_path / "results")
    recs = spark.createDataFrame(_records(), REC)
    rf.write_result_files(recs, path)
    schema = rf.result_schema(recs)
    before = _digests(path)
    assert len(before) == 3
    f0, f1, f2 = (f"nl_sql_{i}.jsonl" for i in range(3))
    bad = rf.grade_result_files(spark, path, schema, _grades(spark, [
        (f0, 0, False, " first ", 0), (f0, 0, True, "second", 5), (f0, 1, True, None, 1),
        (f2, 7, True, "past the end", 0), (f2, -1, True, "", 0), ("other", 0, True, "", 0), (None, 0, True, "", 0), (f1, None, True, "", 0)]))
    assert sorted((r.file, r["index"]) for r in bad.collect() if r.file and r["index"] is not None) == [(f2, -1), (f2, 7), ("other", 0)]
    assert bad.count() == 5
    after = _digests(path)
    assert after[f"file={f0}"] != before[f"file={f0}"]
    # files without a valid grade are untouched, to the byte
    assert {f: d for f, d in after.items() if f != f"file={f0}"} == {f: d for f, d in before.items() if f != f"file={f0}"}
    rf.grade_result_files(spark, path, schema, _grades(spark, [(f0, 1, False, "again", 9), (f1, 3, True, "late", 9)]))
    assert _digests(path)[f"file={f2}"] == before[f"file={f2}"]
    got = {(r.file, r["index"]): r for r in rf.read_result_files(spark, path, schema).collect()}
    assert len(got) == 21
    assert (got[f0, 0].correct, got[f0, 0].note) == (True, "second")  # of the first grading
    assert (got[f0, 1].correct, got[f0, 1].note, got[f0, 1].graded_at) == (False, "again", "2024-03-01T12:09:00+00:00")
    assert got[f1, 3].note == "late" and got[f1, 2].note is None
    own = {(r[0], r[1]): r for r in _records()}
    for k, r in got.items():
        assert r.model == own[k][3] and r.latency_s == own[k][8] and (r.note is not None or r.correct == own[k][6])


def test_grading_by_join_and_without_valid_grades(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rf, "NAMED_FILES", 1)
    path = str(tmp_path / "results")
    recs = spark.createDataFrame(_records(4), REC)
    rf.write_result_files(recs, path)
    schema, before = rf.result_schema(recs), _digests(path)
    assert rf.grade_result_files(spark, path, schema, _grades(spark, [("x", 0, True, "", 0), ("nl_sql_1.jsonl", 99, True, "", 0)])).count() == 2
    assert rf.grade_result_files(spark, path, schema, _grades(spark, [])).count() == 0
    assert _digests(path) == before
    rf.grade_result_files(spark, path, schema, _grades(spark, [(f"nl_sql_{f}.jsonl", f, None, "open again", 0) for f in range(3)]))
    assert sum(_digests(path)[f] == d for f, d in before.items()) == 1
    assert rf.read_result_files(spark, path, schema).where("note = 'open again' and correct is null").count() == 3


# ------------------------------------------------------------------------ T-1
@pytest.fixture
def live(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "summary")
    for d in ("records", "grades"):
        (src / d).mkdir(parents=True)
    schema = spark.createDataFrame([], REC).schema
    names = [f.name for f in schema.fields]
    done = []

    class Live:
        records, grades = [], []

        def write(self, records=(), grades=()):
            n = len(done)
            done.append(n)
            if records:
                self.records += records
                (src / "records" / f"p{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in records) + "\n")
            if grades:
                self.grades += grades
                (src / "grades" / f"p{n}.json").write_text("\n".join(json.dumps(
                    {"file": f, "index": i, "correct": c, "note": t, "graded_at": (T0 + dt.timedelta(minutes=m)).isoformat()})
                    for f, i, c, t, m in grades) + "\n")

        def run(self):
            sg.graded_summary(spark, str(src / "records"), str(src / "grades"), schema, str(tmp_path / "state"), out).awaitTermination()
            return _rows(sg.latest_summary(spark, out))

        def batch(self):
            recs = spark.createDataFrame(self.records, schema)
            merged = ev.apply_grades(recs, ev.last_grades(_grades(spark, self.grades)))
            return _rows(ev.summarize_records(merged))

        versions = staticmethod(lambda: sg.summary_versions(spark, out))
        args = (str(src / "records"), str(src / "grades"), schema, str(tmp_path / "state"), out)
    return Live()


def test_live_summary_follows_grades(spark, live):
    live.write(_records())
    assert live.run() == live.batch() and live.versions() == [0]
    f0, f1 = "nl_sql_0.jsonl", "nl_sql_1.jsonl"
    live.write(grades=[(f0, 0, False, "", 1), (f0, 2, True, "", 1), (f1, 1, None, "", 1), (f0, 99, True, "", 1), ("later.jsonl", 0, False, "", 1)])
    assert live.run() == live.batch() and live.versions() == [0, 1]
    # graded again: the later time wins, whenever it comes; equal times by verdict
    live.write(grades=[(f0, 0, True, "", 9), (f0, 2, False, "", 0), (f1, 1, True, "", 1)])
    assert live.run() == live.batch()
    # a record that comes after its grade, and a new file
    live.write([("later.jsonl", 0, 1, "m9", "", None, None, "2.5", None, None, None)], [("later.jsonl", 0, True, "x", 2)])
    got = live.run()
    assert got == live.batch() and ("m9", "unknown", 1, 1, 0, 1, 1.0, 2.5) in got
    # a restart without new files makes no new version
    assert live.run() == got and live.versions() == [0, 1, 2, 3]


def test_blocks_of_a_long_file(spark, live, monkeypatch):
    recs = [("big.jsonl", i, i, "m", "t", None, None, str(i % 7), None, None, None) for i in range(0, 3500)]
    live.write(recs)
    live.write(grades=[("big.jsonl", i, i % 3 == 0, None, i) for i in range(0, 3500, 5)])
    assert live.run() == live.batch()


def test_sink_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "v")
    one = spark.createDataFrame([("m", "t", 1, 2, 3, 5, 1, 10)], sg._CHANGE)
    back = spark.createDataFrame([("m", "t", 1, 1, -1, 0, 0, 0), ("n", "t", 0, 0, 1, 1, 0, 0)], sg._CHANGE)
    gone = spark.createDataFrame([("n", "t", 0, 0, -1, -1, 0, 0)], sg._CHANGE)
    assert sg.latest_summary(spark, out).count() == 0
    sg.add_changes(one, 0, out)
    for _ in range(3):  # a batch that is run again replaces its version
        sg.add_changes(back, 1, out)
        assert _rows(sg.latest_summary(spark, out).select("model", "correct", "graded", "pending", "total")) == [
            ("m", 2, 3, 2, 5), ("n", 0, 0, 1, 1)]
    # a version that was not finished does not count
    os.makedirs(f"{out}/version=2")
    assert sg.summary_versions(spark, out) == [0, 1]
    for b in range(2, 6):
        sg.add_changes(gone if b == 2 else one.limit(0), b, out, keep=2)
    assert sg.summary_versions(spark, out) == [2, 3, 4, 5] or sg.summary_versions(spark, out) == [3, 4, 5]
    assert [r.model for r in sg.latest_summary(spark, out).collect()] == ["m"]


def test_grades_between_two_triggers(spark, live):
    """The running form, as a watcher of the grading would see it."""
    live.write(_records())
    rd, gd, schema, state, out = live.args
    q = sg.graded_summary(spark, rd, gd, schema, state, out, every_seconds=1)
    try:
        q.processAllAvailable()
        assert _rows(sg.latest_summary(spark, out)) == live.batch()
        live.write(grades=[("nl_sql_2.jsonl", i, True, "", i) for i in range(5)])
        q.processAllAvailable()
        assert _rows(sg.latest_summary(spark, out)) == live.batch()
    finally:
        q.stop()
