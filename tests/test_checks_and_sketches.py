"""S-5 counts, S-2, K-10 with the scan, A-16 by sketches, packed texts, windows off the full hour, total order."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from roomlens.operators import evaluate as ev, kg, room
from roomlens.sources import files

METRICS = ["temperature_c", "humidity_rh"]


@pytest.fixture
def broken(tmp_path):
    (tmp_path / "a_measurements_IAQ_1h_avg.csv").write_text(
        "Date,temperature_c,samples_per_hour\n2024-01-01 00:00:00,21.5,4\nnot a time,NaN,four\n,warm,\n2024-13-01,, \n")
    (tmp_path / "b_measurements_IAQ_1h_avg.csv").write_text(
        "Date,humidity_rh,heat_stable,note\n2024-01-02 00:00:00,4o,maybe,x\n2024-01-02 01:00:00,40,true,y\n")
    (tmp_path / "c_measurements_IAQ_1h_avg.csv").write_text("Date,humidity_rh,heat_stable,note\n")
    return [str(p) for p in tmp_path.iterdir()]


def test_room_quality_by_file(spark, broken):
    got = {(r.file, r.column): (r.rows, r.missing, r.bad) for r in files.room_csv_quality(spark, broken, METRICS).collect()}
    a, b = (f"{x}_measurements_IAQ_1h_avg.csv" for x in "ab")
    assert got == {(a, "Date"): (4, 1, 2), (a, "temperature_c"): (4, 2, 1), (a, "samples_per_hour"): (4, 2, 1),
                   (b, "Date"): (2, 0, 0), (b, "humidity_rh"): (2, 0, 1), (b, "heat_stable"): (2, 0, 1)}


def test_room_quality_observed_in_the_same_pass(spark, broken):
    seen = Observation("quality")
    df = files.read_room_csvs(spark, broken, METRICS, seen)
    assert df.columns == files.read_room_csvs(spark, broken, METRICS).columns
    assert len(df.collect()) == 6
    assert seen.get == {"rows": 6, "bad_Date": 2, "bad_heat_stable": 1, "bad_humidity_rh": 1, "bad_samples_per_hour": 1, "bad_temperature_c": 1}


def test_single_file_override(spark, broken, tmp_path):
    assert len(files.list_room_csvs(spark, str(tmp_path))) == 3
    (tmp_path / files.SINGLE_FILE).write_text("Date,humidity_rh\n2024-01-03 00:00:00,50\n")
    paths = files.list_room_csvs(spark, str(tmp_path))
    assert [r.location for r in files.read_room_csvs(spark, paths, METRICS).collect()] == ["unknown"]


def test_dataset_lineage(spark, broken):
    t = [("d1", kg.RDF_TYPE, kg.EX + "Dataset"), ("d1", kg.RDFS_LABEL, "One"), ("d1", kg.EX + "coversLocation", "l"), ("l", kg.RDFS_LABEL, "Room A"),
         ("d1", kg.EX + "sourceFile", "a_measurements_IAQ_1h_avg.csv"), ("d2", kg.RDF_TYPE, kg.EX + "Dataset"), ("d2", kg.RDFS_LABEL, "Two"),
         ("d2", kg.EX + "coversLocation", "l"), ("d2", kg.EX + "sourceFile", "gone.csv")]
    triples = spark.createDataFrame([(*x, "string") for x in t], kg.TRIPLE_SCHEMA)
    got = sorted((tuple(r) for r in kg.dataset_lineage(triples, files.room_file_rows(spark, broken)).collect()), key=repr)
    assert got == sorted([("d1", "Room A", "a_measurements_IAQ_1h_avg.csv", 4, "read"), ("d2", "Room A", "gone.csv", None, "no-file"),
                          (None, None, "b_measurements_IAQ_1h_avg.csv", 2, "no-dataset")], key=repr)


def test_sketches_merge_within_the_error(spark, tmp_path):
    rng = random.Random(1)
    rows = [("big", i % 9, rng.lognormvariate(0, 2)) for i in range(60_000)] + [("few", i % 3, float(i)) for i in range(40)]
    rows += [("few", 0, None), ("few", 1, float("nan")), ("none", 0, None)] + [("same", 0, 5.0)] * 3000
    pred = spark.createDataFrame(rows, "model string, day int, latency_s double")
    path = str(tmp_path / "sketches")
    ev.latency_sketches(pred, ["model", "day"]).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 14 and stored.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    est = {r.model: r for r in ev.sketched_quantiles(stored, ["model"], {"median": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    assert {m: r.n for m, r in est.items()} == {"big": 60_000, "few": 40, "same": 3000}
    exact = {r.model: r for r in ev.latency_stats(pred.where("not isnan(latency_s)"), ["model"]).collect()}
    values = sorted(v for m, _, v in rows if m == "big")
    for q, name in ((0.5, "median"), (0.95, "p95"), (0.99, "p99")):
        rank = sum(v <= est["big"][name] for v in values) / len(values)
        assert abs(rank - q) <= ev.SKETCH_ERROR, (name, rank)
    # small groups are exact
    assert est["few"].p95 == exact["few"].latency_p95_s == 37.0 and abs(est["few"].median - exact["few"].latency_median_s) <= 0.5
    assert est["same"].median == est["same"].p99 == 5.0
    spans = {r.model: r for r in ev.rank_spans(pred, ev.sketched_quantiles(stored, ["model"], {"p95": 0.95}), ["model"], ["p95"]).collect()}
    assert spans["same"].p95_below == 0 and spans["same"].p95_upto == 1 and spans["few"].n == 40


def test_packed_texts_equal_the_folder_form(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "03_kg_on_plot_gas_resistance_for_2024-01-02_in_office", "one\ntwo"),
                                  ("m1", "04_default_plot_humidity_for_2024-01-02_in_kitchen", ""), ("m 2", "readme", "stray")],
                                 "model_dir string, stem string, content string")
    files.write_artifacts(rows, str(tmp_path / "tree"))
    files.pack_artifacts(rows, str(tmp_path / "packed"))
    packed = files.scan_packed_artifacts(spark, str(tmp_path / "packed"))
    got = {tuple(r)[:6] for r in packed.where("stray is null").collect()}
    assert got == {("m1", 3, "kg_on", "gas resistance", "2024-01-02", "office"), ("m1", 4, "default", "humidity", "2024-01-02", "kitchen")}
    tree = files.scan_artifacts(spark, str(tmp_path / "tree"))
    assert {r.text for r in tree.where("stray is null").collect()} >= {"one\ntwo"}
    assert packed.where("stray is not null").count() == tree.where("stray is not null").count() == 1
    assert packed.where("stray is not null").first().text == "stray"


def test_images_sorted_or_an_error(spark, tmp_path):
    d = tmp_path / "img"
    (d / "sub").mkdir(parents=True)
    (d / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        files.scan_images(spark, str(d))
    for n in ("b.PNG", "sub/a.jpeg", "a.webp"):
        (d / n).write_bytes(b"1")
    assert [r.name for r in files.scan_images(spark, str(d)).collect()] == ["a.webp", "b.PNG", "a.jpeg"]


def test_binary_files_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.png", b"\x00\xff1"), ("a/y.JPG", b""), ("a/x.png", b"\x00\xff1"), ("n.txt", b"t")],
                                 "path string, content binary")
    root = str(tmp_path / "tree")
    assert files.write_binary_files(rows, "path", "content", root) == 3
    assert files.write_binary_files(rows.limit(0), "path", "content", root) == 0
    got = [(r.folder, r.name, r.ext, r.b64) for r in files.scan_images(spark, root).collect()]
    assert got == [("a", "x.png", "png", "AP8x")]  # a file without bytes is written, but not listed
    names = [p.name for p in (tmp_path / "tree").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert sorted(names) == ["n.txt", "x.png", "y.JPG"]
    for bad in (("../x.png", b"1"), ("/x.png", b"1"), (None, b"1"), ("x.png", None)):
        with pytest.raises(Exception, match="no file can be written"):
            files.write_binary_files(spark.createDataFrame([bad], "path string, content binary"), "path", "content", root)
    with pytest.raises(ValueError, match="mounted"):
        files.write_binary_files(rows, "path", "content", "s3a://bucket/x")


def test_card_windows_off_the_full_hour(spark):
    """Readings at any minute count; a window's end is open."""
    t = dt.datetime
    rows = [(t(2024, 1, 1, 8, 29, 59), 50.0), (t(2024, 1, 1, 8, 30), 22.0), (t(2024, 1, 1, 9, 0), 24.0), (t(2024, 1, 2, 8, 0), 23.0),
            (t(2024, 1, 2, 8, 29), 29.0), (t(2024, 1, 2, 8, 30), 90.0)]
    iaq = spark.createDataFrame([(d, "office", v, v) for d, v in rows], "Date timestamp_ntz, location string, temperature_c double, humidity_rh double")
    req = spark.createDataFrame([("a", "2024-01-01 08:30", None), ("b", "2024-01-01", "office"), ("c", "2024-01-01 08:30:00.5", "office"),
                                 ("d", "2024-01-02 09:00", "office")], "request_id string, date string, location string")
    got = {r.request_id: (r.value, r.status) for r in room.cards_for_requests(req, iaq, room.metric_dim(spark)).where("title = 'temperature_c'").collect()}
    assert got["a"] == (24.5, "ok")  # 22, 24, 23, 29
    assert got["b"] == (32.0, "warn-high")  # 50, 22, 24
    assert got["c"] == (41.5, "warn-high")  # 24, 23, 29, 90
    assert got["d"] == (None, "no-data")


def test_series_in_total_order(spark):
    """A long undated series spans partitions, and the whole is sorted."""
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(3000)]
    iaq = spark.createDataFrame([(d, r, float(i % 50), 40.0, 990.0, 1.0, 1.0) for i, d in enumerate(days) for r in ("office", "kitchen")],
                                "Date timestamp_ntz, location string, temperature_c double, humidity_rh double, pressure_hpa double, "
                                "gas_resistance_ohms double, IAQ_proxy double")
    req = spark.createDataFrame([(1, "plot temperature in office"), (2, "plot humidity"), (3, "plot temperature for 2024-01-05 in kitchen")],
                                "request_id long, request string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = room.series_with_band(req, iaq, room.metric_dim(spark)).withColumn("pid", F.spark_partition_id())
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    keys = [(r.series, r.Date, r.location) for r in rows]
    assert len(rows) == 3000 + 6000 + 24 and keys == sorted(keys)
    sizes = {}
    for r in rows:
        sizes[r.pid] = sizes.get(r.pid, 0) + 1
    assert max(sizes.values()) < 4000 and len({r.pid for r in rows if r.series == max(k[0] for k in keys)}) >= 1
