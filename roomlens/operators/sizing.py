"""Broadcast a derived table only behind a measured size.

A side computed from the data (not a fixed list) has no static bound, so it
is materialised once with a reliable checkpoint under the shared
``spark.checkpoint.dir`` (one computation, lineage cut, survives executor
loss), its payload bytes are summed on the executors (one number comes
back), and it is broadcast only when that is within the session's
``spark.sql.autoBroadcastJoinThreshold``.  Above it the join stays a
shuffle join, where AQE can still split skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# per-value overhead assumed on top of string payload (row header, offsets)
_FIXED_BYTES = 16


def _threshold(df: DataFrame) -> int:
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = raw.strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for u in sorted(units, key=len, reverse=True):
        if raw.endswith(u):
            return int(float(raw[: -len(u)]) * units[u])
    return int(raw)


def _row_bytes(df: DataFrame) -> Column:
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + _FIXED_BYTES)
        elif isinstance(f.dataType, (ArrayType, MapType)):
            # written as JSON a value takes about as many bytes as in a row
            one = F.to_json(F.struct(c.alias("v")))
            parts.append(F.coalesce(F.octet_length(one) + _FIXED_BYTES * F.size(c), F.lit(0)) + _FIXED_BYTES)
        elif isinstance(f.dataType, StructType):
            parts.append(F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + _FIXED_BYTES * len(f.dataType.fields))
        else:
            parts.append(F.lit(_FIXED_BYTES))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    from roomlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    limit = _threshold(df) if max_bytes is None else max_bytes
    m = df.checkpoint(eager=True)
    size = m.select(F.sum(_row_bytes(m)).alias("b")).first()["b"] or 0
    return F.broadcast(m) if 0 <= size <= limit else m
