"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and cut into blocks of
about eight dimensions.  Cosine ``t`` means a squared distance of ``2 - 2t``;
if two vectors are that close, at least one block holds no more than its
proportional share of it.  So each block is a range join in few dimensions: a
grid over the block's first four dimensions deals out every vector to its own
cell and to those neighbouring cells that its range reaches.  All pairs whose
block distance is within the share are candidates, and the union over the
blocks is verified by the exact cosine in double precision.  A pair is counted
in the first block that finds it.

The unit vectors are written once under ``spark.checkpoint.dir`` and mapped into
memory by workers; only cell keys and vector numbers are shuffled, packed.
Links are not sent on as pairs: a task hands on partial sums of links per
vector, and so many links as connect what it found connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import deltas, map_array, mix64, mounted_folder, pack, unpack, write_array
from roomlens.llm.graph import connected_components
from roomlens.session import scratch_path

BLOCK, GRID = 8, 4
TILE = 1024
HOT = 4096  # vectors of one cell that a task takes; more are split
SHARD_BYTES = 150_000_000  # vectors that the entries of one task look up, at 12 bytes a number
# Turned coordinates are kept as whole multiples of 1/SCALE, so that block
# distances are exact sums in any order and every task decides alike; the
# shares are widened by what rounding can add.
SCALE = 1024
_ROW = np.uint64(32)


def blocks_of(d: int) -> list[tuple[int, int]]:
    n = min(256, max(1, d // BLOCK))
    cut = [d * i // n for i in range(n + 1)]
    return list(zip(cut[:-1], cut[1:]))


def shares_of(d: int, cosine: float) -> list[float]:
    """Largest squared block distance, in units of 1/SCALE squared."""
    limit = 2 - 2 * cosine + 1e-9
    return [(SCALE * np.sqrt(limit * (hi - lo) / d) + np.sqrt(hi - lo)) ** 2 for lo, hi in blocks_of(d)]


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _cell_keys(cell: np.ndarray, b: int) -> np.ndarray:
    """64-bit keys of grid cells, the block's number in the low byte."""
    key = np.full(len(cell), b + 1, np.uint64)
    for c in range(cell.shape[1]):
        key = mix64(key + cell[:, c].astype(np.int64).view(np.uint64))
    return key & ~np.uint64(0xFF) | np.uint64(b)


def _grid(turned: np.ndarray, b: int, cosine: float):
    """Cell of each vector in block b, its nearer neighbour in each grid
    dimension and the distance to it; a cell is twice the reach wide."""
    lo, hi = blocks_of(turned.shape[1])[b]
    width = 2 * np.sqrt(shares_of(turned.shape[1], cosine)[b]) * (1 + 1e-6)
    at = turned[:, lo: lo + min(GRID, hi - lo)] / width
    cell = np.floor(at).astype(np.int64)
    part = at - cell
    return cell, np.where(part < 0.5, -1, 1), np.where(part < 0.5, part, 1 - part) * width


def _cells(turned: np.ndarray, number: np.ndarray, cosine: float, hot: dict[int, int]):
    """(cell key, vector number, 0 home / 1 visit) arrays of all blocks.  A
    pair of different cells meets in the larger cell of the two.  ``hot``
    cells are split in so many parts: a vector lives in one part and visits
    the later ones, guests visit all."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    busy = np.array(sorted(hot), np.uint64)

    def put(key, who, visit):
        cold = ~np.isin(key, busy) if len(busy) else np.ones(len(key), bool)
        out.append((key[cold], who[cold], np.full(int(cold.sum()), visit, np.uint8)))
        for k in np.unique(key[~cold]).tolist():
            mine = who[key == np.uint64(k)]
            own = (mix64(mine) % np.uint64(hot[k])).astype(np.int64)
            for s in range(hot[k]):
                name = mix64(np.array([k + s + 1], np.uint64)) & ~np.uint64(0xFF) | np.uint64(k & 0xFF)
                for ids, v in ([(mine, 1)] if visit else [(mine[own == s], 0), (mine[own < s], 1)]):
                    out.append((np.repeat(name, len(ids)), ids, np.full(len(ids), v, np.uint8)))

    for b, share in enumerate(shares_of(turned.shape[1], cosine)):
        cell, side, gap = _grid(turned, b, cosine)
        put(_cell_keys(cell, b), number, 0)
        for move in product((0, 1), repeat=cell.shape[1]):
            m = np.array(move)
            if m.any():
                first = int(np.argmax(m))
                ok = ((gap * gap * m).sum(1) <= share * (1 + 1e-6)) & (side[:, first] > 0)
                put(_cell_keys((cell + side * m)[ok], b), number[ok], 1)
    return tuple(np.concatenate(x) for x in zip(*out))


class _Links:
    """Partial sums of links and connecting links of one task."""

    def __init__(self, size: np.ndarray):
        self.size, self.links = size, np.zeros(len(size), np.int64)
        self.parent = np.arange(len(size))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def add(self, rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> None:
        """Count the links of a tile; connect by one link per row and column
        at a time until the tile joins nothing more."""
        np.add.at(self.links, rows, linked @ self.size[cols])
        np.add.at(self.links, cols, linked.T @ self.size[rows])
        while linked.any():
            r = np.flatnonzero(linked.any(1))
            for i, j in zip(rows[r].tolist(), cols[linked[r].argmax(1)].tolist()):
                self.join(i, j)
            c = np.flatnonzero(linked.any(0))
            for i, j in zip(rows[linked[:, c].argmax(0)].tolist(), cols[c].tolist()):
                self.join(i, j)
            a = np.array([self.find(i) for i in rows.tolist()])
            b = np.array([self.find(j) for j in cols.tolist()])
            linked = linked & (a[:, None] != b[None, :])


def _join_cells(key, table: pa.Table, folder: str, d: int, cosine: float) -> pa.Table:
    cell, number, visit = (np.concatenate(x) for x in zip(*(
        (np.cumsum(c, dtype=np.uint64), n, v) for c, n, v in (unpack(b.as_py()) for b in table.column("blob")))))
    used, local = np.unique(number, return_inverse=True)
    part = (used >> _ROW).astype(np.int64)
    unit, size = np.empty((len(used), d)), np.empty(len(used), np.int64)
    turned = np.empty((len(used), d), np.float32)
    for p in np.unique(part).tolist():
        here = part == p
        row = (used[here] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        unit[here], size[here] = map_array(folder, f"unit_{p}")[row], map_array(folder, f"size_{p}")[row]
        turned[here] = map_array(folder, f"turned_{p}")[row]
    links, spans, shares = _Links(size), blocks_of(d), shares_of(d, cosine)
    norms = [(turned[:, lo:hi] ** 2).sum(1) for lo, hi in spans]
    order = np.lexsort((visit, cell))
    cell, local, visit = cell[order], local[order], visit[order]
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))

    def near(b: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        lo, hi = spans[b]
        return norms[b][rows][:, None] + norms[b][cols][None, :] - 2 * (turned[rows, lo:hi] @ turned[cols, lo:hi].T) \
            <= shares[b]

    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        b = int(cell[a] & np.uint64(0xFF))
        homes = local[a:z][visit[a:z] == 0]
        guests = local[a:z][visit[a:z] == 1]
        for i in range(0, len(homes), TILE):
            rows = homes[i: i + TILE]
            for others, j in [(homes, j) for j in range(i, len(homes), TILE)] + \
                    [(guests, j) for j in range(0, len(guests), 4 * TILE)]:
                own = others is homes
                cols = others[j: j + (TILE if own else 4 * TILE)]
                ok = near(b, rows, cols)
                if own and i == j:
                    ok = np.triu(ok, 1)
                x, y = np.nonzero(ok)
                if not len(x):
                    continue
                # The whole tile is worked on where much of it is near, else its rows and columns that are.
                r, c = np.unique(x), np.unique(y)
                if len(r) * len(c) > 16 * len(x):
                    one = np.einsum("ij,ij->i", unit[rows[x]], unit[cols[y]]) >= cosine
                    x, y = x[one], y[one]
                    for lo, hi in spans[:b]:
                        gap = turned[rows[x], lo:hi] - turned[cols[y], lo:hi]
                        fresh = (gap * gap).sum(1) > shares[spans.index((lo, hi))]
                        x, y = x[fresh], y[fresh]
                    if len(x):
                        r, c = np.unique(x), np.unique(y)
                        linked = np.zeros((len(r), len(c)), bool)
                        linked[np.searchsorted(r, x), np.searchsorted(c, y)] = True
                        links.add(rows[r], cols[c], linked)
                    continue
                linked = ok[np.ix_(r, c)]
                for e in range(b):
                    if linked.any():
                        linked &= ~near(e, rows[r], cols[c])
                if linked.any():
                    linked &= unit[rows[r]] @ unit[cols[c]].T >= cosine
                    links.add(rows[r], cols[c], linked)
    some = np.flatnonzero(links.links)
    edges = np.array(links.edges, np.int64).reshape(-1, 2)
    none = np.zeros(len(edges), np.int64)
    return pa.Table.from_arrays(
        [pa.array(np.concatenate((used[some], used[edges[:, 0]])).view(np.int64)),
         pa.array(np.concatenate((np.zeros(len(some), np.int64), used[edges[:, 1]].view(np.int64)))),
         pa.array(np.concatenate((links.links[some], none)))], names=["a", "b", "n"])



def near_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
               cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) per row: the number of other rows
    with cosine ``cosine`` or more, the smallest id reachable by such links,
    and whether that is the row's own id.

    A vector that is null, empty or all zeros, or that holds nulls, NaN or
    infinite values, links with nothing; so does a row whose id is null (its
    component is null, kept false).  Vectors of different lengths do not
    link.  Equal vectors are worked on once.  Ids are integers and unique;
    other columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    fit = F.coalesce(F.col("id").isNotNull() & F.col("v").isNotNull()
                     & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                     & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(fit, F.col("v")).alias("v"))
    found = [_one_length(rows.where(F.size("v") == d), d, cosine)
             for (d,) in rows.where("v is not null").select(F.size("v")).distinct().collect()]
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for x in found:
        alone = alone.union(x)
    return alone.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _one_length(rows: DataFrame, d: int, cosine: float) -> DataFrame:
    spark = rows.sparkSession
    folder = mounted_folder(spark, "vectors")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The number of the task's attempt, which no other attempt of the
        # application has; the table of numbers names those that counted.
        file = TaskContext.get().taskAttemptId()
        if file >= 1 << 31:
            raise ValueError("file numbers have 31 bits")
        units, sizes = [], []
        done = 0
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            v = v / np.abs(v).max(1, keepdims=True)
            units.append(v / np.linalg.norm(v, axis=1, keepdims=True))
            sizes.append(batch.column(2).to_numpy(zero_copy_only=False))
            n = len(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(n, file, np.int64)),
                 pa.array((file << 32) + done + np.arange(n))], names=["v", "cid", "size", "file", "number"])
            done += n
        if units:
            unit = np.concatenate(units)
            write_array(folder, f"unit_{file}", unit)
            write_array(folder, f"size_{file}", np.concatenate(sizes))
            write_array(folder, f"turned_{file}", np.rint(unit @ rotation(d) * SCALE).astype(np.int16))

    table = scratch_path(spark, "numbers")
    rows.groupBy("v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("size")) \
        .mapInArrow(write, "v array<double>, cid long, size long, file long, number long").write.parquet(table)
    numbers = spark.read.parquet(table)
    files = numbers.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(f.n for f in files)
    bits = max(4, int(np.ceil(np.log2(max(1, 5 * len(blocks_of(d)) * total * 12 * d / SHARD_BYTES)))))
    listed = spark.createDataFrame([(f.file,) for f in files], "file long").repartition(len(files))

    def turned(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                t = np.array(map_array(folder, f"turned_{file}"), np.float64)
                yield t, (np.uint64(file) << _ROW) + np.arange(len(t), dtype=np.uint64)

    def crowded(batches):
        for t, _ in turned(batches):
            for b in range(len(blocks_of(d))):
                key, count = np.unique(_cell_keys(_grid(t, b, cosine)[0], b), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["cell", "n"])

    hot = {r.cell % (1 << 64): -(-r.n // HOT) for r in listed.mapInArrow(crowded, "cell long, n long")
           .groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).collect()}

    def deal(batches):
        for t, number in turned(batches):
            key, who, visit = _cells(t, number, cosine, hot)
            shard = (mix64(key) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((key, shard))
            key, who, visit, shard = key[order], who[order], visit[order], shard[order]
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[a])], pa.int32()),
                     pa.array([pack(deltas(key[a:z]), who[a:z], visit[a:z])], pa.binary())], names=["shard", "blob"])

    pairs = scratch_path(spark, "links")
    listed.mapInArrow(deal, "shard int, blob binary").groupBy("shard") \
        .applyInArrow(lambda k, t: _join_cells(k, t, folder, d, cosine), "a long, b long, n long").write.parquet(pairs)
    pairs = spark.read.parquet(pairs)
    name = numbers.select("number", "cid", "size")
    links = pairs.where("n > 0").groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("links"))
    edges = pairs.where("n = 0").join(name.select(F.col("number").alias("a"), F.col("cid").alias("x")), "a") \
        .join(name.select(F.col("number").alias("b"), F.col("cid").alias("y")), "b")
    merged = connected_components(edges, "x", "y").withColumnRenamed("node", "cid")
    classes = numbers.join(links, "number", "left").join(merged, "cid", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "cid").alias("component_id"))
    return rows.join(classes, "v").select("id", "n_links", "component_id")
