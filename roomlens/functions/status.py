"""Range-compliance rules as column expressions.

The reference has three rules that differ on purpose (SURVEY 2.12 trap 8);
they are kept separate.  All are plain CASE expressions, so they stay inside
whole-stage codegen.  A NULL mean (no numeric reading: the reference's NaN)
gives ``no-data`` instead of the reference's accidental ``ok`` (trap 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric columns whose cards/plots use a comfort band.
BANDED_METRICS = ["temperature_c", "humidity_rh"]


def card_status(metric: Column, value: Column, lo: Column, hi: Column,
                kg_disabled: Column | bool = False) -> Column:
    """A-5a: off -> unknown; non-banded metric or a missing bound -> info;
    strict < min warn-low, > max warn-high; else ok."""
    off = kg_disabled if isinstance(kg_disabled, Column) else F.lit(bool(kg_disabled))
    return (F.when(off, "unknown")
            .when(~metric.isin(*BANDED_METRICS) | lo.isNull() | hi.isNull(), "info")
            .when(value.isNull(), "no-data")
            .when(value < lo, "warn-low")
            .when(value > hi, "warn-high")
            .otherwise("ok"))


def result_status(value: Column, lo: Column, hi: Column, has_range: Column) -> Column:
    """A-5b: one-sided bounds allowed; no range entry -> info."""
    return (F.when(lo.isNotNull() & (value < lo), "warn-low")
            .when(hi.isNotNull() & (value > hi), "warn-high")
            .when(has_range, "ok")
            .otherwise("info"))


def oracle_status(value: Column, lo: Column, hi: Column,
                  kg_disabled: Column | bool = False) -> Column:
    """A-5c: constant ranges; off or unlisted metric -> unknown."""
    off = kg_disabled if isinstance(kg_disabled, Column) else F.lit(bool(kg_disabled))
    return (F.when(off | lo.isNull() | hi.isNull(), "unknown")
            .when(value.isNull(), "no-data")
            .when(value < lo, "warn-low")
            .when(value > hi, "warn-high")
            .otherwise("ok"))


def safe_limit_state(obs_min: Column, obs_max: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """A-8: inclusive bounds; returns (expected_safe_state, violation)."""
    within = (obs_min >= lo) & (obs_max <= hi)
    state = F.when(within, "within_safe_limit").otherwise("outside_safe_limit")
    violation = (F.when(within, F.lit(None).cast("string"))
                 .when((obs_min < lo) & (obs_max > hi), "below_and_above")
                 .when(obs_min < lo, "below")
                 .otherwise("above"))
    return state, violation
