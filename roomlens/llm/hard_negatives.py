"""Hard-negative mining by slot-decomposed selection.

An anchor's positives have upper limits for the scores of their negatives:
``high`` percent of the positive's own score.  Sorted downwards, the limits
split the scores into disjoint slots, and a positive's window is its own
slot and all lower ones.  So each score is looked at once per anchor: it goes
to its slot, of which only the first ``k`` are kept, task by task.  The slots
of an anchor, one after another, are in descending order, and the window of
the i-th positive is the first ``k`` of the slots from i on.

Anchors meet rows in cells of bounded size: rows are dealt into blocks by a
hash, anchors into blocks too, and a cell is one block of each.  A cell sends
on at most ``k`` rows per anchor and slot, so no task ever holds an anchor's
scores or a label's rows as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import package_on_workers, scratch_path

BLOCK_BYTES = 4 << 20  # of a cell's rows, and of its anchors, as doubles
MATRIX = 1 << 21  # scores held at once
_LONG = np.iinfo(np.int64)


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return np.floor(flat * scale).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b: as
    doubles where every sum is below 2**53, else as Python integers, kept
    within the range of a long."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if most < 2.0 ** 53:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, int(_LONG.min), int(_LONG.max))


def _first(s: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest, equal ones by position."""
    if len(s) > k:
        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        return near[np.argsort(-s[near], kind="stable")[:k]]
    return np.argsort(-s, kind="stable")


def _cell(anchors: pa.Table, rows: pa.Table, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, scores of all rows) of a cell."""
    if not len(anchors) or not len(rows):
        return
    b = _matrix(rows["vector"], scale)
    step = max(1, MATRIX // len(rows))
    for at in range(0, len(anchors), step):
        part = anchors.slice(at, step)
        for i, s in enumerate(_products(_matrix(part["vector"], scale), b)):
            yield at + i, s


_FOUND = "anchor long, ark long, slot int, score long, id long, rk long"


def _emit(found: list[tuple[int, int, np.ndarray, np.ndarray]], anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """Rows of _FOUND of (anchor's place, slot, scores, row places)."""
    size = [len(f[2]) for f in found]
    who = np.repeat(np.array([f[0] for f in found], np.int64), size)
    at = np.concatenate([f[3] for f in found]) if found else np.zeros(0, np.int64)
    score = np.concatenate([f[2].astype(np.int64) for f in found]) if found else np.zeros(0, np.int64)
    one = {n: c.to_numpy() for n, c in (("id", rows["id"]), ("rk", rows["rk"]))}
    return pa.table({"anchor": anchors["id"].to_numpy()[who], "ark": anchors["rk"].to_numpy()[who],
                     "slot": np.repeat(np.array([f[1] for f in found], np.int32), size), "score": score,
                     "id": one["id"][at], "rk": one["rk"][at]})


def _positives(k: int, scale: float):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("rk", "ascending")])
        label, rk, ids = (rows[c].to_numpy() for c in ("label", "rk", "id"))
        own = [anchors[c].to_numpy() for c in ("label", "rk", "id")]
        found = []
        for i, s in _cell(anchors, rows, scale):
            same = np.flatnonzero((label == own[0][i]) & ~((rk == own[1][i]) & (ids == own[2][i])))
            best = same[_first(s[same], k)]
            found.append((i, 0, s[best], best))
        return _emit(found, anchors, rows)
    return run


def _negatives(k: int, scale: float):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("rk", "ascending")])
        label, own = rows["label"].to_numpy(), anchors["label"].to_numpy()
        upper, lower = anchors["upper"].to_pylist(), anchors["lower"].to_pylist()
        found = []
        for i, s in _cell(anchors, rows, scale):
            for j, (top, bottom) in enumerate(zip(upper[i], lower[i])):
                # the slot reaches down to the next limit; what is below the
                # lowest bound of all windows that reach it is wanted by none
                inside = (s <= top) & (s >= bottom) & (label != own[i])
                if j + 1 < len(upper[i]):
                    inside &= s > upper[i][j + 1]
                at = np.flatnonzero(inside)
                if len(at):
                    best = at[_first(s[at], k)]
                    found.append((i, j, s[best], best))
        return _emit(found, anchors, rows)
    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row of ``vectors`` where ``is_anchor`` holds and
    each of its ``positives`` best other rows of the same label, the first
    ``k`` rows of another label whose score is between ``low`` and ``high``
    percent of the positive's (limits included).

    A score is the inner product with the anchor after each component became
    floor(scale * x); it is exact, and held at the ends of a long's range.
    Higher scores come first, then smaller ids.  The label is the column
    ``label`` or the given expression.

    Rows take no part whose id, label or vector is null, or that have a null
    or non-finite component.  Rows equal in id, label and vector count once;
    rows of one id with other vectors are rows of their own, ordered by a hash.
    Vectors of different lengths have no score with each other.  An anchor
    without positives, and a window without rows, give no rows.  Other columns
    are not read."""
    spark = vectors.sparkSession
    package_on_workers(spark)
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high must hold")
    label = F.col("label") if label is None else label
    ends = [float("inf"), float("-inf")]
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | x.isin(ends))
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
                          F.xxhash64(label).alias("lab"), label.isNull().alias("no_label"), F.coalesce(is_anchor, F.lit(False)).alias("asks")) \
        .where("id is not null and vector is not null and not no_label").where(~F.coalesce(bad, F.lit(False))) \
        .select("id", F.col("lab").alias("label"), "vector", "asks").distinct() \
        .withColumn("rk", F.xxhash64("id", "label", "vector")).withColumn("dim", F.size("vector"))
    path = scratch_path(spark, "negatives-rows")
    base.write.parquet(path)
    base = spark.read.parquet(path)
    blocks = broadcast_if_small(base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("na")).select(
        "dim", *[F.ceil(F.col(c) * F.greatest("dim", F.lit(1)) * 8 / BLOCK_BYTES).alias(to) for c, to in (("n", "nr"), ("na", "ns"))]))
    rows = base.join(blocks, "dim").withColumn("r", F.pmod(F.xxhash64("rk", "id"), F.col("nr"))) \
        .withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ns") - 1))).where("ns > 0") \
        .select("dim", "r", "a", "id", "rk", "label", "vector")

    def meet(anchors: DataFrame, extra: list[str], work) -> DataFrame:
        asked = anchors.withColumn("a", F.pmod(F.xxhash64("rk", "id"), F.col("ns"))) \
            .withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1))) \
            .select("dim", "r", "a", "id", "rk", "label", "vector", *extra)
        cell = ["dim", "r", "a"]
        return asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(work, _FOUND)

    order = [F.col("score").desc(), "id", "rk"]
    anchors = spark.read.parquet(path).where("asks").join(blocks, "dim")
    best = meet(anchors, [], _positives(positives, scale)) \
        .withColumn("place", F.row_number().over(Window.partitionBy("anchor", "ark").orderBy(*order))) \
        .where(F.col("place") <= positives)
    best = best.groupBy("anchor", "ark").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("pos")).checkpoint()
    limits = best.select(F.col("anchor").alias("id"), F.col("ark").alias("rk"),
                         F.transform("pos.score", lambda s: F.floor(s.cast("decimal(38,0)") * high / 100).cast("long")).alias("upper"),
                         F.transform("pos.score", lambda s: F.ceil(s.cast("decimal(38,0)") * low / 100).cast("long")).alias("lower"))
    kept = meet(anchors.join(limits, ["id", "rk"]), ["upper", "lower"], _negatives(k, scale)) \
        .withColumn("place", F.row_number().over(Window.partitionBy("anchor", "ark", "slot").orderBy(*order))) \
        .where(F.col("place") <= k)
    slots = kept.groupBy("anchor", "ark").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("all"))
    windows = best.join(slots, ["anchor", "ark"]).select("anchor", "all", F.posexplode("pos").alias("i", "p")) \
        .select("anchor", "p", F.slice(F.filter("all", lambda x: x["slot"] >= F.col("i")), 1, k).alias("first")) \
        .select("anchor", "p", F.posexplode(F.filter("first", lambda x: x["score"].cast("decimal(38,0)") * 100
                                                     >= F.col("p.score").cast("decimal(38,0)") * low)).alias("at", "x"))
    return windows.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                          F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"))
