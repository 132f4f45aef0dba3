"""Rounding that agrees across engines.

Averages of decimal inputs often land exactly on a rounding tie
(x.xxxxxx5).  Two engines summing in different orders then differ by a few
ulps and round the tie apart.  Snapping to 8 decimals first removes the ulp
noise (far below 1e-8 for these magnitudes), so the final round sees the
same double in every engine.

The final round is half-up on the decimal value (Spark rounds a double
through its shortest decimal text, so 32.494999999999997 -> "32.495" ->
32.5).  DuckDB rounds the binary value instead (-> 32.49), so its twin
casts the snapped value to an exact decimal before rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_round(c: Column | str, digits: int) -> Column:
    return F.round(F.round(c, 8), digits)


def sql_round(expr: str, digits: int) -> str:
    """The same rule as SQL text (for the DuckDB oracle)."""
    return f"cast(round(cast(round({expr}, 8) as decimal(38, 8)), {digits}) as double)"


def fixed_rows(names: list[str], rows: list[tuple]) -> Column:
    """Generator column: `df.select("*", fixed_rows(...))` repeats each input
    row once per literal tuple.  Used instead of a cross join with a fixed
    list: the list travels inside the plan as literals, each task expands its
    own rows, and nothing is joined or shuffled."""
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))
