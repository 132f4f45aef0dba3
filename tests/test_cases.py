"""G-1..G-5 on a 2-day x 3-room table: the reference's case counts
(30 question, 30 plot, 30 chart, 12 ablation x 2 conditions)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roomlens.operators import cases, room


@pytest.fixture(scope="module")
def iaq(spark):
    rows = [(dt.datetime(2024, 1, d, h), loc, 21.0, 40.0, 1000.0, 5000.0, 10.0)
            for d in (1, 2) for h in (0, 1) for loc in ("hallway", "kitchen", "office")]
    return spark.createDataFrame(
        rows, "Date timestamp_ntz, location string, temperature_c double, humidity_rh double, "
              "pressure_hpa double, gas_resistance_ohms double, IAQ_proxy double")


def test_question_cases(iaq):
    q = iaq.transform(cases.question_cases).collect()
    assert len(q) == 30
    assert "What is the average temperature of kitchen?" in {r.text for r in q}
    assert "What is the minimum temperature of hallway?" in {r.text for r in q}


def test_plot_and_chart_cases(iaq):
    p = cases.plot_cases(iaq).orderBy("case_index").collect()
    assert len(p) == 30 and [r.case_index for r in p] == list(range(30))
    assert p[0].text == "plot temperature for 2024-01-01 in hallway"
    c = cases.chart_cases(iaq).orderBy("case_index").collect()
    assert [r.question for r in c[:6]] == cases.CHART_QUESTIONS + cases.CHART_QUESTIONS[:1]


def test_card_cases(iaq):
    assert cases.card_cases(iaq).count() == 2 * 3 * 2


def test_ablation_cases(spark, iaq):
    banded = room.metric_dim(spark).where(F.col("has_range")).select("metric")
    a = cases.ablation_cases(iaq, banded).collect()
    assert len(a) == 24
    for cond in cases.CONDITIONS:
        idx = sorted(r["index"] for r in a if r.condition == cond)
        assert idx == list(range(1, 13))
    assert {r.expected_metric for r in a} == {"temperature_c", "humidity_rh"}
