"""S-1..S-5 room CSVs and S-8 N-Triples on files written by the test."""


import pytest

from roomlens.operators import kg
from roomlens.sources import files

METRICS = ["temperature_c", "humidity_rh"]


@pytest.fixture()
def room_dir(tmp_path):
    d = tmp_path / "rooms"
    d.mkdir()
    (d / "Living_Room_measurements_IAQ_1h_avg.csv").write_text(
        "Date,temperature_c,humidity_rh\n2024-01-01 00:00:00,21.5,40\n2024-01-01 01:00:00,NaN,41\n")
    (d / "my-kitchen_measurements_IAQ_1h_avg.csv").write_text(
        "Date,temperature_c\nnot a time,22\n")
    (d / "office_measurements_IAQ_1h_avg.csv").write_text(
        "Date,location,temperature_c,extra\n2024-01-02 00:00:00,Office,23,x\n")
    (d / "override.csv").write_text("Date,humidity_rh\n2024-01-03 00:00:00,50\n")
    return d


def test_room_csvs_union_by_name(spark, room_dir):
    paths = [str(p) for p in room_dir.iterdir()]
    df = files.read_room_csvs(spark, paths, METRICS)
    assert df.columns == sorted(df.columns)
    rows = df.collect()
    locs = sorted({r.location for r in rows})
    # the name must match from its start, lower-cased; no match -> unknown
    assert locs == ["living_room", "office", "unknown"]
    by = {(r.location, str(r.Date)): r for r in rows}
    assert by[("living_room", "2024-01-01 01:00:00")].temperature_c is None      # NaN -> NULL
    kitchen = [r for r in rows if r.temperature_c == 22.0][0]
    assert kitchen.Date is None and kitchen.temperature_c == 22.0               # bad timestamp -> NULL
    assert kitchen.humidity_rh is None and kitchen.extra is None                # union fills NULLs
    assert by[("office", "2024-01-02 00:00:00")].extra == "x"


def test_room_csvs_require_a_file(spark):
    with pytest.raises(FileNotFoundError):
        files.read_room_csvs(spark, [], METRICS)


def test_ntriples_roundtrip(spark, tmp_path):
    rows = kg.seed_rows() + [(kg.EX + "odd", kg.RDFS_LABEL, 'say "hi" \\ bye', "string")]
    src = spark.createDataFrame(rows, kg.TRIPLE_SCHEMA)
    path = str(tmp_path / "g.nt")
    files.write_ntriples(src, path)
    back = files.read_ntriples(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_room_csvs_one_read_per_header(spark, tmp_path):
    d = tmp_path / "same"
    d.mkdir()
    for room in ("hallway", "kitchen", "office"):
        (d / f"{room}_measurements_IAQ_1h_avg.csv").write_text("Date,temperature_c\n2024-01-01 00:00:00,20\n")
    df = files.read_room_csvs(spark, [str(p) for p in d.iterdir()], METRICS)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1            # three files, one header, one scan
    assert sorted(r.location for r in df.collect()) == ["hallway", "kitchen", "office"]


def test_room_names_with_spaces_and_folder_scan(spark, tmp_path):
    for name in ("my room", "hall"):
        (tmp_path / f"{name}_measurements_IAQ_1h_avg.csv").write_text("Date,temperature_c\n2024-01-01 00:00:00,20\n")
    (tmp_path / "other.csv").write_text("Date\n2024-01-01 00:00:00\n")
    paths = files.list_room_csvs(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["hall_measurements_IAQ_1h_avg.csv", "my room_measurements_IAQ_1h_avg.csv"]
    assert sorted(r.location for r in files.read_room_csvs(spark, paths, METRICS).collect()) == ["hall", "unknown"]
    (tmp_path / files.SINGLE_FILE).write_text("Date,temperature_c\n2024-01-01 00:00:00,20\n")
    assert len(files.list_room_csvs(spark, str(tmp_path))) == 1


def test_ntriples_variants_and_bad_lines(spark, tmp_path):
    lines = ['<a:s> <a:p> "x"@en .', '_:b1   <a:p>\t<a:o> .', '<a:s> <a:p> _:b2 . # note', '# comment', '',
             '<a:s> <a:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', 'not a triple']
    (tmp_path / "g.nt").write_text("\n".join(lines))
    got = {tuple(r) for r in files.read_ntriples(spark, str(tmp_path / "g.nt")).collect()}
    assert got == {("a:s", "a:p", "x", "string"), ("_:b1", "a:p", "a:o", "iri"), ("a:s", "a:p", "b2", "blank"),
                   ("a:s", "a:p", "5", "string")}
    assert [r.value for r in files.bad_ntriples(spark, str(tmp_path / "g.nt")).collect()] == ["not a triple"]


def test_ntriples_line_breaks_survive(spark, tmp_path):
    rows = [("a:s", "a:p", 'one\ntwo\t"three" \\n \\\\', "string")]
    path = str(tmp_path / "g.nt")
    files.write_ntriples(spark.createDataFrame(rows, kg.TRIPLE_SCHEMA), path)
    assert [tuple(r) for r in files.read_ntriples(spark, path).collect()] == rows


def test_image_scan_and_base64_check(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(files.PNG_MAGIC + b"x")
    (tmp_path / "sub" / "b.JPG").write_bytes(b"jpeg")
    (tmp_path / "c.txt").write_bytes(b"text")
    got = files.check_base64(files.scan_images(spark, str(tmp_path)), "b64").collect()
    assert sorted((r.name, r.ext, r.size, r.decodes, r.is_png) for r in got) == [
        ("a.png", "png", 9, True, True), ("b.JPG", "jpg", 4, True, False)]
    bad = spark.createDataFrame([("!!",), (None,)], "b64 string")
    assert {(r.size, r.decodes, r.is_png) for r in files.check_base64(bad, "b64").collect()} == {(None, False, False)}
