"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item of n words is compared with the n-word windows of every
text.  A window's 64-bit SimHash over its words is looked up in a multi-index
over the items' fingerprints: the bits are cut into blocks, and the index
holds every value within ``radius // blocks`` flipped bits of each item's
block.  Two fingerprints within the radius agree that closely in at least one
block, so all of them are found.  Candidates within the radius are verified
exactly by weighted shingle similarity: the weight of the shared shingles over
the weight of all distinct ones, a shingle weighing ``log(1 + items / items
that hold it)``.

Windows that hold no shingle of any item of their size have similarity 0 and
are not fingerprinted; this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import WordHasher, kgrams, mix64, text_runs, words_of
from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import scratch_path, session_conf

BITS = 64
_SEEN = 1 << 20
_MASK = (1 << 64) - 1
WORDS = r"[^\x20\x09-\x0D]+"
# Words of the items that are indexed at a time.
BLOCK_WORDS = 2_000_000
# Texts that a worker is handed at a time.
BATCH_ROWS = 1000
# Digests of contaminated texts are broadcast up to this measured size, else shuffled.
BROADCAST_BYTES = 32 << 20
SCHEMA = "contaminated boolean, n_items long, item_ids array<long>, max_similarity double"


def _fingerprints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n words from each start on."""
    bits = np.unpackbits(mix64(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = 2 * (total[starts + n] - total[starts]) > n
    return np.packbits(ones, axis=1).view(np.uint64).reshape(-1)


class ItemIndex:
    """Fingerprints, shingles and weights of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], k: int, blocks: int, radius: int,
                 weight_of: dict[int, float], unseen: float):
        hasher = WordHasher()
        self.k, self.blocks, self.radius = k, blocks, radius
        self.weight_of, self.unseen = weight_of, unseen
        self.ids = [i for i, _ in items]
        self.size = np.array([len(w) for _, w in items], np.int64)
        hashes = [hasher.flat([w])[0] for _, w in items]
        self.sets = [np.unique(kgrams(h, min(k, len(h)))) for h in hashes]
        self.weight = [self.weigh(s) for s in self.sets]
        self.fp = np.array([_fingerprints(h, np.zeros(1, np.int64), len(h))[0] for h in hashes], np.uint64)
        # shingle -> sizes of the items that hold it, by shingle length
        self.anchors: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[int]]]] = {}
        for s, n in zip(self.sets, self.size.tolist()):
            held = self.anchors.setdefault(min(k, n), (None, None, {}))[2]
            for x in s.tolist():
                if n not in held.setdefault(x, []):
                    held[x].append(n)
        for g, (_, _, held) in self.anchors.items():
            keys = np.sort(np.fromiter(held, np.uint64, len(held)))
            seen = np.zeros(_SEEN, bool)
            seen[(keys & np.uint64(_SEEN - 1)).astype(np.int64)] = True
            self.anchors[g] = (keys, seen, held)
        width = BITS // blocks
        flips = [sum(1 << b for b in c) for d in range(radius // blocks + 1) for c in combinations(range(width), d)]
        self.tables = []
        for b in range(blocks):
            value = (self.fp >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            keys = (value[:, None] ^ np.array(flips, np.uint64)[None, :]).reshape(-1)
            item = np.repeat(np.arange(len(self.fp)), len(flips))
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], item[order]))

    def weigh(self, shingles: np.ndarray) -> float:
        return sum(self.weight_of.get(x, self.unseen) for x in shingles.tolist())

    def lookup(self, fps: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(window, item) within the radius, for items of n words."""
        width = BITS // self.blocks
        found = set()
        for b, (keys, item) in enumerate(self.tables):
            value = (fps >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            lo, hi = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
            for w in np.flatnonzero(hi > lo).tolist():
                for i in item[lo[w]: hi[w]].tolist():
                    if self.size[i] == n:
                        found.add((w, i))
        return [(w, i) for w, i in found if int(fps[w] ^ self.fp[i]).bit_count() <= self.radius]

    def matches(self, h: np.ndarray, hits: dict[int, list[tuple[int, int]]], at_least: float) -> dict[int, float]:
        """item index -> best similarity, for one text with its anchor hits
        (size -> [(position, shingle length)])."""
        best: dict[int, float] = {}
        for n, places in hits.items():
            g = min(self.k, n)
            size = min(n, len(h))  # a text shorter than the item is one window
            starts = np.unique(np.concatenate([np.arange(p - (size - g), p + 1) for p in places]))
            starts = starts[(starts >= 0) & (starts + size <= len(h))]
            lo, hi = int(starts[0]), int(starts[-1]) + size
            part = h[lo:hi]
            fps = _fingerprints(part, starts - lo, size)
            grams = kgrams(part, g)
            for w, i in self.lookup(fps, n):
                at = int(starts[w]) - lo
                own = np.unique(grams[at: at + size - g + 1])
                both = self.weigh(np.intersect1d(own, self.sets[i], assume_unique=True))
                alike = both / (self.weight[i] + self.weigh(own) - both)
                if alike >= at_least - 1e-12 and alike > best.get(i, 0.0):
                    best[i] = alike
        return best

    def scan(self, h: np.ndarray, lens: np.ndarray, at_least: float) -> dict[int, dict[int, float]]:
        """text index -> matches, over the words of several texts."""
        ends = np.cumsum(lens)
        begins = ends - lens
        hits: dict[int, dict[int, list[int]]] = {}
        for g, (keys, seen, held) in self.anchors.items():
            s = kgrams(h, g)
            place = np.flatnonzero(seen[(s & np.uint64(_SEEN - 1)).astype(np.int64)])
            at = np.searchsorted(keys, s[place])
            place = place[keys[np.minimum(at, len(keys) - 1)] == s[place]]
            text = np.searchsorted(ends, place, side="right")
            inside = place + g <= ends[text] if len(place) else np.zeros(0, bool)
            for p, d in zip(place[inside].tolist(), text[inside].tolist()):
                for n in held[int(s[p])]:
                    hits.setdefault(d, {}).setdefault(n, []).append(p - int(begins[d]))
        return {d: m for d, by in hits.items()
                if (m := self.matches(h[begins[d]: ends[d]], by, at_least))}


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", k: int = 5, at_least: float = 0.75,
                  blocks: int = 4, radius: int = 15, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, contaminated, n_items, item_ids, max_similarity) for every row.

    The items are a stated query set: they are taken in blocks of about
    ``block_words`` words, each indexed on the driver (items, fingerprints and
    the weights of their own shingles are bounded by that number) and compared
    with all texts, one block after another.  How many items hold a shingle is
    counted in Spark.  The result is written under ``spark.checkpoint.dir``.

    Null text counts as empty, which matches nothing (similarity 0); items
    that are null or without words match nothing.  Items of fewer than k
    words are one shingle.  Repeated rows give one result each, null ids are
    passed through; equal items under several ids all count.  Other columns
    are ignored."""
    texts = docs.select(F.col(f"`{id_col}`").alias("row_"), F.col(f"`{text_col}`").alias("text_"))
    return _matched(texts, items, item_col, item_text_col, k, at_least, blocks, radius, block_words) \
        .withColumnRenamed("row_", id_col)


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", k: int = 5, at_least: float = 0.75, blocks: int = 4,
                         radius: int = 15, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item (as above).

    Only texts and their digests go through the workers; the rows that go are
    those whose text has the digest of a contaminated one."""
    digest = F.unhex(F.sha2(F.col(f"`{text_col}`"), 256))
    texts = docs.select(digest.alias("row_"), F.col(f"`{text_col}`").alias("text_"))
    own = "_digest"
    while own in docs.columns:
        own += "_"
    gone = _matched(texts, items, item_col, item_text_col, k, at_least, blocks, radius, block_words) \
        .where("contaminated").select(F.col("row_").alias(own)).distinct()
    return docs.withColumn(own, digest).join(broadcast_if_small(gone, BROADCAST_BYTES), own, "left_anti").drop(own)


def _matched(texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, k: int, at_least: float,
             blocks: int, radius: int, block_words: int) -> DataFrame:
    spark = texts.sparkSession
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t")) \
        .where("i is not null")
    words, total = rows.select(F.regexp_count("t", F.lit(WORDS)).alias("n")).agg(
        F.sum("n"), F.coalesce(F.count_if(F.col("n") > 0), F.lit(0))).first()
    groups = max(1, -(-(words or 0) // block_words))
    shingles = rows.mapInArrow(_item_shingles(k), "i long, x long")
    shared = shingles.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    unseen = float(np.log1p(total))
    if groups > 1:
        # every block scans the same written rows, which have their number in them
        path = scratch_path(spark, "scanned-texts")
        texts.withColumn("at_", F.monotonically_increasing_id()).write.parquet(path)
        texts = spark.read.parquet(path)
    found = scratch_path(spark, "scanned-marks")
    for g in range(groups):
        here = F.pmod(F.xxhash64("i"), F.lit(groups)) == g
        listed = sorted((r.i, w) for r in rows.where(here).collect() if (w := words_of(r.t or "")))
        weights = {r.x & _MASK: float(np.log1p(total / r.c)) for r in
                   shared.join(shingles.where(here).select("x").distinct(), "x").collect()}
        index = spark.sparkContext.broadcast(ItemIndex(listed, k, blocks, radius, weights, unseen))
        # Written at once: in a plan that is run later, batches would have the
        # session's size, 10,000 texts, on both sides of every worker.
        with session_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
            _scan(texts, index, at_least).write.mode("append").parquet(found)
        index.unpersist()
    marks = spark.read.parquet(found)
    if groups > 1:
        marks = marks.drop("row_").groupBy("at_").agg(
            F.max("contaminated").alias("contaminated"), F.sum("n_items").alias("n_items"),
            F.sort_array(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("max_similarity").alias("max_similarity"))
        marks = texts.select("at_", "row_").join(marks, "at_").drop("at_")
    return marks


def _item_shingles(k: int):
    """Distinct shingles of each item, all of its words if it has fewer."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(t or "")
                if w:
                    x = np.unique(kgrams(hasher.flat([w])[0], min(k, len(w)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(x)], names=["i", "x"])
    return work


def _scan(texts: DataFrame, index, at_least: float) -> DataFrame:
    numbered = "at_" in texts.columns
    kind = texts.schema["row_"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemIndex = index.value
        hasher = WordHasher()
        for batch in batches:
            out: list[dict[int, float]] = []
            for _, texts in text_runs(batch.column(1)):
                h, lens = hasher.flat([words_of(t) for t in texts])
                found = own.scan(h, lens, at_least)
                out += [found.get(d, {}) for d in range(len(lens))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bool(m) for m in out]), pa.array([len(m) for m in out], pa.int64()),
                 pa.array([sorted(own.ids[i] for i in m) for m in out], pa.list_(pa.int64())),
                 pa.array([max(m.values(), default=0.0) for m in out], pa.float64())] + [batch.column(i) for i in range(2, batch.num_columns)],
                names=["row_", "contaminated", "n_items", "item_ids", "max_similarity"] + ["at_"] * numbered)

    return texts.mapInArrow(work, f"row_ {kind}, {SCHEMA}" + ", at_ long" * numbered)
