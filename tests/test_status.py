"""A-5a/b/c and A-8: the three status rules stay different (trap 8); a NULL
mean (the reference's NaN) is no-data, not ok (trap 1)."""

from pyspark.sql import functions as F

from roomlens.functions import status as st


def _eval(spark, rows, expr_fn):
    df = spark.createDataFrame(rows, "metric string, v double, lo double, hi double")
    return [r[0] for r in df.select(expr_fn(F.col("metric"), F.col("v"), F.col("lo"), F.col("hi"))).collect()]


def test_card_status_exclusive_bounds(spark):
    rows = [("temperature_c", 20.0, 20.0, 26.0), ("temperature_c", 19.99, 20.0, 26.0),
            ("temperature_c", 26.01, 20.0, 26.0), ("temperature_c", 26.0, 20.0, 26.0),
            ("pressure_hpa", 1000.0, 950.0, 1050.0), ("humidity_rh", 50.0, None, 60.0),
            ("humidity_rh", None, 30.0, 60.0)]
    got = _eval(spark, rows, lambda m, v, lo, hi: st.card_status(m, v, lo, hi))
    assert got == ["ok", "warn-low", "warn-high", "ok", "info", "info", "no-data"]
    off = _eval(spark, rows[:1], lambda m, v, lo, hi: st.card_status(m, v, lo, hi, kg_disabled=True))
    assert off == ["unknown"]


def test_result_status_one_sided(spark):
    rows = [("x", 5.0, None, 4.0), ("x", 3.0, None, 4.0), ("x", 1.0, 2.0, None), ("x", 1.0, None, None)]
    has = [True, True, True, False]
    df = spark.createDataFrame([(*r, h) for r, h in zip(rows, has)],
                               "metric string, v double, lo double, hi double, has boolean")
    got = [r[0] for r in df.select(st.result_status(F.col("v"), F.col("lo"), F.col("hi"), F.col("has"))).collect()]
    assert got == ["warn-high", "ok", "warn-low", "info"]


def test_oracle_status(spark):
    rows = [("x", 21.0, 20.0, 26.0), ("x", 30.0, 20.0, 26.0), ("x", 21.0, None, 26.0), ("x", None, 20.0, 26.0)]
    got = _eval(spark, rows, lambda m, v, lo, hi: st.oracle_status(v, lo, hi))
    assert got == ["ok", "warn-high", "unknown", "no-data"]


def test_safe_limit_inclusive(spark):
    df = spark.createDataFrame([(20.0, 26.0), (19.0, 25.0), (21.0, 27.0), (19.0, 27.0)], "mn double, mx double")
    state, viol = st.safe_limit_state(F.col("mn"), F.col("mx"), F.lit(20.0), F.lit(26.0))
    got = [tuple(r) for r in df.select(state, viol).collect()]
    assert got == [("within_safe_limit", None), ("outside_safe_limit", "below"),
                   ("outside_safe_limit", "above"), ("outside_safe_limit", "below_and_above")]


def test_rounding_trap(spark):
    """Trap 2: SQL half-up on the value snapped to 8 places (2.675 -> 2.68,
    0.125 -> 0.13, and the double 32.494999999999997 -> 32.5), unlike
    Python's binary half-even round."""
    from roomlens.functions.numeric import stable_round
    df = spark.createDataFrame([(2.675,), (0.125,), (32.494999999999997,), (1.0049999999,), (1.00499,)],
                               "v double")
    got = [r[0] for r in df.select(stable_round(F.col("v"), 2)).collect()]
    # within 1e-8 of a tie counts as the tie (summation-order noise); further away does not
    assert got == [2.68, 0.13, 32.5, 1.01, 1.0]
