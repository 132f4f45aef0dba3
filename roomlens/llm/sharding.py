"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose
size is a prime: an offset and a step drawn from hashes of its name.  The
shards take turns, each claiming its next free slot, until the table is full;
so each holds nearly the same number of slots, and a shard that leaves or joins
moves few others.  The table has a fixed size, is broadcast, and a row finds
its shard by one equi-join on ``hash(key) mod size``.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Index of the shard that holds each slot.  A shard of weight w claims w
    slots each turn."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, at least the number of shards")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, nor all zero")
    place = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 if size > 1 else 0 for s in shards]
    table = [-1] * size
    free = size
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + step[i]) % size
                table[place[i]] = i
                free -= 1
                if not free:
                    return table


def place(docs: DataFrame, shards: list[str], id_col: str = "doc_id", text_col: str | None = "text",
          size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """(id, slot, shard) per row.

    The key is the id as text; a row whose id is null is placed by its text,
    so that such rows do not meet in one shard (no text either: the empty
    key).  Repeated ids share a shard.  Other columns are ignored.  The
    broadcast holds ``size`` rows, whatever the input."""
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(slot, shards[i]) for slot, i in enumerate(fill_table(shards, size, weights))],
        StructType([StructField("slot", IntegerType()), StructField("shard", StringType())]))
    key = [F.col(f"`{id_col}`").cast("string")] + ([F.col(f"`{text_col}`")] if text_col else []) + [F.lit("")]
    rows = docs.select(F.col(f"`{id_col}`"), F.pmod(F.xxhash64(F.coalesce(*key)), F.lit(size).cast(LongType()))
                       .cast("int").alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(F.col(f"`{id_col}`"), "slot", "shard")
