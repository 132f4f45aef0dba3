"""Room aggregates on a hand-made iaq table, checked against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roomlens.operators import room



@pytest.fixture(scope="module")
def iaq(spark):
    recs = []
    for day in (1, 2):
        for h in range(4):
            for loc, base in (("kitchen", 20.0), ("office", 25.0)):
                t = base + h + day
                recs.append((dt.datetime(2024, 1, day, h), loc, t, 40.0 + h, 1000.0, 5000.0, 10.0 * h))
    # a room with no temperature readings at all on day 1
    recs.append((dt.datetime(2024, 1, 1, 5), "hallway", None, 50.0, 1000.0, 1.0, 1.0))
    return spark.createDataFrame(
        recs, "Date timestamp_ntz, location string, temperature_c double, humidity_rh double, "
              "pressure_hpa double, gas_resistance_ohms double, IAQ_proxy double")


def test_daily_cards_against_python(spark, iaq):
    dim = room.metric_dim(spark)
    cards = {(r.day, r.location, r.title): (r.value, r.status)
             for r in room.daily_cards(iaq, dim).collect()}
    ranges = {r.metric: (r.lo, r.hi) for r in dim.collect()}
    lo, hi = ranges["temperature_c"]
    for day in (1, 2):
        for loc, base in (("kitchen", 20.0), ("office", 25.0)):
            mean = sum(base + h + day for h in range(4)) / 4
            exp = "warn-low" if mean < lo else "warn-high" if mean > hi else "ok"
            assert cards[(f"2024-01-0{day}", loc, "temperature_c")] == (round(mean, 2), exp)
    # trap 1: an all-missing metric is no-data, never ok
    assert cards[("2024-01-01", "hallway", "temperature_c")] == (None, "no-data")


def test_cards_kg_off(spark, iaq):
    st = {r.status for r in room.daily_cards(iaq, room.metric_dim(spark), kg_disabled=True).collect()}
    assert st == {"unknown"}


def test_location_stats(spark, iaq):
    got = {(r.location, r.metric): (r.mean, r.min, r.max) for r in room.location_stats(iaq).collect()}
    vals = [20.0 + h + d for d in (1, 2) for h in range(4)]
    assert got[("kitchen", "temperature_c")] == (sum(vals) / len(vals), min(vals), max(vals))
    assert got[("hallway", "temperature_c")] == (None, None, None)


def test_ticker_text(spark, iaq):
    t = {(r.day, r.location): r.ticker for r in room.daily_ticker(iaq).collect()}
    assert t[("2024-01-01", "kitchen")] == "temperature_c: 22.5 • humidity_rh: 41.5"
    assert t[("2024-01-01", "hallway")] == "temperature_c: nan • humidity_rh: 50.0"


def test_safe_limits_rows(spark, iaq):
    out = room.safe_limits(iaq, room.metric_dim(spark))
    assert set(out.columns) >= {"expected_safe_state", "violation"}
    # every (day, room) with readings of a banded metric gets one row per banded metric
    n = out.where(F.col("location") == "kitchen").count()
    assert n == 2 * 2


def test_window_means_half_open(spark, iaq):
    """F-1: [d0, d1) excludes d1; J-1 means come from day-level (sum, count)."""
    req = spark.createDataFrame([("r1", dt.date(2024, 1, 1), dt.date(2024, 1, 2), "kitchen", "temperature_c"),
                                 ("r2", dt.date(2024, 1, 1), dt.date(2024, 1, 3), "kitchen", "temperature_c"),
                                 ("r3", dt.date(2024, 1, 5), dt.date(2024, 1, 6), "kitchen", "temperature_c")],
                                "request_id string, d0 date, d1 date, room string, metric string")
    got = {r.request_id: r.value_mean for r in room.window_means(req, room.day_totals(iaq)).collect()}
    day1 = [21.0 + h for h in range(4)]
    both = day1 + [22.0 + h for h in range(4)]
    assert got["r1"] == pytest.approx(sum(day1) / 4)
    assert got["r2"] == pytest.approx(sum(both) / 8)
    assert got.get("r3") is None


def test_cards_for_requests_regex_locations(spark, iaq):
    """F-2 regex form: searched in the lower-cased location; several rooms
    combine into one mean; no match -> no-data; bad date -> bad-date."""
    req = spark.createDataFrame([("a", "2024-01-01", "^K"), ("b", "2024-01-01", "office|kitchen"),
                                 ("c", "2024-01-01", "garage"), ("d", "2024-13-45", "kitchen")],
                                "request_id string, date string, location string")
    out = {(r.request_id, r.title): (r.value, r.status)
           for r in room.cards_for_requests(req, iaq, room.metric_dim(spark)).collect()}
    kitchen = [20.0 + h + 1 for h in range(4)]
    office = [25.0 + h + 1 for h in range(4)]
    assert out[("a", "temperature_c")][0] == round(sum(kitchen) / 4, 2)
    assert out[("b", "temperature_c")][0] == round(sum(kitchen + office) / 8, 2)
    assert out[("c", "temperature_c")] == (None, "no-data")
    assert out[("d", "humidity_rh")] == (None, "bad-date")
