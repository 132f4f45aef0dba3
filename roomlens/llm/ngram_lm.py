"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Training is three passes of numpy work inside tasks, with Spark dealing packed
arrays between them:

1. words: each task counts its words and ships (hash, count) arrays by hash
   range; one task per range writes the sorted word hashes.  A word's number
   is its rank in that order over all ranges.
2. pairs: each task maps the word hashes into memory, numbers its words and
   ships (pair key, count) arrays, dealt by a hash of the pair, so that a
   frequent word's pairs are spread over all shards.  One task per shard
   writes its sorted pair keys and counts.
3. each shard passes on, by ranges of word numbers, its partial sums per
   context (total, and how many pairs occur once, twice, more often) and per
   continued word (distinct predecessors).  One task per range adds them up
   and writes the dense arrays.

The files lie under ``spark.checkpoint.dir`` and workers map them into memory
(the page cache holds what is used); nothing but a few numbers per shard comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import (WordHasher, deltas, map_array, mix64, mounted_folder, pack, text_runs, total_bytes,
                                 unpack, words_of, write_array)

# The end token and the start context; white space, so no word equals them.
END, START = b"\n", b"\r"
FLUSH = 2_000_000
SHARD_BYTES = 14_000_000
STATS = pa.schema([("part", pa.int32()), ("numbers", pa.list_(pa.int64()))])
STATS_SQL = "part int, numbers array<long>"


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _rows(shard_of: np.ndarray, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Ship sorted arrays (the first as differences) split by shard."""
    order = np.argsort(shard_of, kind="stable")
    s = shard_of[order]
    cut = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)])) if len(s) else np.zeros(1, int)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        part = [x[order[a:b]] for x in arrays]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(s[a])], pa.int32()), pa.array([pack(deltas(part[0]), *part[1:])], pa.binary())],
            names=["shard", "blob"])


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


@dataclass
class Model:
    """Where the arrays lie and the few numbers that all workers need."""
    folder: str
    bits: int
    starts: list[int] = field(default_factory=list)  # first word number of each range
    vocabulary: int = 0
    tokens: int = 0
    pairs: int = 0
    pair_ties: list[int] = field(default_factory=list)  # pairs that occur once .. four times
    word_ties: list[int] = field(default_factory=list)  # words with one .. four predecessors

    @property
    def parts(self) -> int:
        return 1 << self.bits


def discounts(ties: list[int]) -> np.ndarray:
    """D1, D2, D3+ from the numbers of items seen once to four times."""
    n = [float(x) for x in ties] + [0.0] * (4 - len(ties))
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y for k in (1, 2, 3)]
    return np.array([0.0] + [min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1)])


class Reader:
    """Memory-mapped view of a model inside a worker."""

    def __init__(self, model: Model):
        self.m = model
        self.files: dict[str, np.ndarray] = {}
        self.hasher = WordHasher()
        ends = self.hasher.flat([[END]])[0]
        self.end = int(ends[0])

    def file(self, name: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = map_array(self.m.folder, name)
        return self.files[name]

    def find(self, prefix: str, keys: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For keys sorted within shards: place in the shard's file, found or not."""
        place, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        cut = np.concatenate(([0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(keys)])) if len(keys) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            held = self.file(f"{prefix}_{int(shards[a])}")
            if len(held):
                at = np.searchsorted(held, keys[a:b])
                ok = at < len(held)
                ok[ok] = held[at[ok]] == keys[a:b][ok]
                place[a:b], known[a:b] = at, ok
        return place, known

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all tokens (an end after each text; unknown words get
        ``vocabulary + 1``), tokens per text, distinct numbers of this run
        and the index of each token among them."""
        lists = [words_of(t) for t in texts]
        for x in lists:
            x.append(END)
        h, lens = self.hasher.flat(lists)
        u, inverse = np.unique(h, return_inverse=True)
        if not self.m.starts:
            return np.full(len(h), 1), lens, np.full(len(u), 1), inverse
        shards = _top(u, self.m.bits)
        place, known = self.find("word", u, shards)
        ids = np.where(known, place + np.array(self.m.starts, np.int64)[shards], self.m.vocabulary + 1)
        return ids[inverse], lens, ids, inverse

    def previous(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        prev = np.empty_like(ids)
        prev[1:] = ids[:-1]
        prev[np.cumsum(lens) - lens] = self.m.vocabulary  # the start context
        return prev

    def gather(self, prefix: str, ids: np.ndarray) -> np.ndarray:
        """Values of a dense array for sorted word numbers, by range."""
        out = None
        step = _range(self.m)
        part = ids // step
        cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(ids)])) if len(ids) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            held = self.file(f"{prefix}_{int(part[a])}")
            got = held[ids[a:b] - int(part[a]) * step]
            out = np.empty(len(ids), held.dtype) if out is None else out
            out[a:b] = got
        return np.zeros(0) if out is None else out


def _range(m: Model) -> int:
    """Word numbers (start context included) per range of dense arrays."""
    return -(-(m.vocabulary + 1) // m.parts)


def _count_words(batches, bits: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    keys, counts, held = [], [], 0
    for batch in batches:
        for _, texts in text_runs(batch.column(0)):
            lists = [words_of(t) for t in texts]
            lists[0].extend([END] * len(lists))
            u, c = np.unique(hasher.flat(lists)[0], return_counts=True)
            keys.append(u)
            counts.append(c)
            held += len(u)
            if held > FLUSH:
                u, c = _merged(keys, counts)
                keys, counts, held = [u], [c], len(u)
                if held > FLUSH:
                    yield from _rows(_top(u, bits), [u, c.astype(np.uint32)])
                    keys, counts, held = [], [], 0
    if keys:
        u, c = _merged(keys, counts)
        yield from _rows(_top(u, bits), [u, c.astype(np.uint32)])


def _arrays(table: pa.Table, column: str = "blob") -> tuple[list[np.ndarray], ...]:
    got = [unpack(b.as_py()) for b in table.column(column)]
    return tuple([np.cumsum(x[0], dtype=np.uint64) if i == 0 else x[i] for x in got] for i in range(len(got[0])))


def _write_words(key, table: pa.Table, folder: str) -> pa.Table:
    shard = key[0].as_py()
    u, c = _merged(*_arrays(table))
    write_array(folder, f"word_{shard}", u)
    write_array(folder, f"count_{shard}", c.astype(np.uint64))
    return pa.Table.from_arrays([pa.array([shard], pa.int32()),
                                 pa.array([[len(u), int(c.sum())]], pa.list_(pa.int64()))], schema=STATS)


def _count_pairs(batches, model: Model) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    keys, held = [], 0

    def ship():
        u, c = np.unique(np.concatenate(keys), return_counts=True)
        yield from _rows(_top(mix64(u), model.bits), [u, c.astype(np.uint32)])

    for batch in batches:
        for _, texts in text_runs(batch.column(0)):
            ids, lens, _, _ = reader.number(texts)
            prev = reader.previous(ids, lens)
            keys.append(prev.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
            held += len(ids)
            if held > FLUSH:
                yield from ship()
                keys, held = [], 0
    if keys:
        yield from ship()


def _write_pairs(key, table: pa.Table, model: Model) -> pa.Table:
    """Write one shard; hand on partial sums by range of word numbers.  Range
    -1 takes the shard's own numbers."""
    shard = key[0].as_py()
    u, c = _merged(*_arrays(table))
    write_array(model.folder, f"pair_{shard}", u)
    # Counts take a byte; the few larger ones stand apart.
    big = np.flatnonzero(c > 254)
    write_array(model.folder, f"few_{shard}", np.minimum(c, 255).astype(np.uint8))
    write_array(model.folder, f"many_at_{shard}", big.astype(np.uint32))
    write_array(model.folder, f"many_{shard}", c[big].astype(np.uint64))
    ties = [int((c == k).sum()) for k in (1, 2, 3, 4)]
    out = [(-1, "own", pack(np.array([len(u), *ties], np.int64)))]
    step = _range(model)
    context = (u >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    sums = [np.add.reduceat(x.astype(np.int64), first).astype(np.uint32)
            for x in (c == 1, c == 2, c > 2)] + [np.add.reduceat(c, first).astype(np.uint64)]
    _by_range(out, "context", context[first], sums, step)
    word, before = np.unique((u & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
    _by_range(out, "word", word, [before.astype(np.uint32)], step)
    return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]),
                                 pa.array([x[2] for x in out], pa.binary())], names=["part", "kind", "blob"])


def _by_range(out: list, kind: str, ids: np.ndarray, arrays: list[np.ndarray], step: int) -> None:
    part = ids // step
    for p in np.unique(part).tolist():
        a, b = np.searchsorted(part, [p, p + 1])
        out.append((p, kind, pack(deltas(ids[a:b].astype(np.uint64)), *[x[a:b] for x in arrays])))


def _write_sums(key, table: pa.Table, model: Model) -> pa.Table:
    part = key[0].as_py()
    if part < 0:
        total = sum(unpack(b.as_py())[0] for b in table.column("blob"))
        numbers = total.tolist()
    else:
        step = _range(model)
        size = min(step, model.vocabulary + 1 - part * step)
        dense = {"once": np.zeros(size, np.uint32), "twice": np.zeros(size, np.uint32),
                 "more": np.zeros(size, np.uint32), "total": np.zeros(size, np.uint64),
                 "before": np.zeros(size, np.uint32)}
        names = {"context": ("once", "twice", "more", "total"), "word": ("before",)}
        for kind, blob in zip(table.column("kind"), table.column("blob")):
            ids, *values = unpack(blob.as_py())
            at = np.cumsum(ids, dtype=np.uint64).astype(np.int64) - part * step
            for name, v in zip(names[kind.as_py()], values):
                dense[name][at] += v
        for name, v in dense.items():
            write_array(model.folder, f"{name}_{part}", v)
        numbers = [int((dense["before"] == k).sum()) for k in (1, 2, 3, 4)]
    return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([numbers], pa.list_(pa.int64()))],
                                schema=STATS)


def fit_lm(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count a model over all rows; null texts count as empty (one end token).
    An empty table gives a model in which every token is unknown."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text_"))
    bits = max(2, int(np.ceil(np.log2(max(1, total_bytes(texts, "text_") / shard_bytes)))))
    model = Model(mounted_folder(docs.sparkSession, "lm"), bits)
    folder = model.folder
    words = texts.mapInArrow(lambda it: _count_words(it, bits), "shard int, blob binary") \
        .groupBy("shard").applyInArrow(lambda k, t: _write_words(k, t, folder), STATS_SQL).collect()
    if not words:
        return model
    sizes = [0] * model.parts
    for r in words:
        sizes[r.part] = r.numbers[0]
        model.tokens += r.numbers[1]
    for p in set(range(model.parts)) - {r.part for r in words}:
        write_array(folder, f"word_{p}", np.zeros(0, np.uint64))
        write_array(folder, f"count_{p}", np.zeros(0, np.uint64))
    model.starts = [0, *np.cumsum(sizes)[:-1].tolist()]
    model.vocabulary = sum(sizes)
    if model.vocabulary >= 1 << 32:
        raise ValueError("word numbers take 32 bits")
    frozen = Model(**vars(model))
    sums = texts.mapInArrow(lambda it: _count_pairs(it, frozen), "shard int, blob binary") \
        .groupBy("shard").applyInArrow(lambda k, t: _write_pairs(k, t, frozen), "part int, kind string, blob binary") \
        .groupBy("part").applyInArrow(lambda k, t: _write_sums(k, t, frozen), STATS_SQL).collect()
    own = next(r.numbers for r in sums if r.part < 0)
    model.pairs, model.pair_ties = own[0], own[1:]
    model.word_ties = np.sum([r.numbers for r in sums if r.part >= 0], axis=0).tolist()
    return model


class Scorer:
    """log10 probabilities of texts under a model."""

    def __init__(self, model: Model):
        self.m, self.reader = model, Reader(model)
        self.d2, self.d1 = discounts(model.pair_ties), discounts(model.word_ties)
        ties = model.word_ties
        self.left_over = 1.0
        if model.vocabulary:
            more = model.vocabulary - ties[0] - ties[1]
            self.left_over = float(self.d1[1] * ties[0] + self.d1[2] * ties[1] + self.d1[3] * more) / model.pairs
        self.uniform = self.left_over / (model.vocabulary + 1)

    def run(self, texts: list[str]):
        """Per text: tokens, known tokens, base score, score."""
        m, r = self.m, self.reader
        ids, lens, distinct, inverse = r.number(texts)
        owner = np.repeat(np.arange(len(lens)), lens)
        sums = lambda x: np.bincount(owner, weights=x, minlength=len(lens))
        known = ids < m.vocabulary if m.vocabulary else np.zeros(len(ids), bool)
        counts = np.zeros(len(distinct))
        single = np.full(len(distinct), self.uniform)
        keep, share = np.zeros(len(distinct)), np.ones(len(distinct))
        start_keep, start_share = 0.0, 1.0
        if m.vocabulary:
            ok = np.flatnonzero(distinct < m.vocabulary)
            own = distinct[ok]  # sorted by hash, hence by number
            shard = np.searchsorted(np.array(m.starts), own, side="right") - 1
            for s in np.unique(shard).tolist():
                here = shard == s
                counts[ok[here]] = r.file(f"count_{s}")[own[here] - m.starts[s]]
            before = r.gather("before", own).astype(np.int64)
            single[ok] += (before - self.d1[np.minimum(before, 3)]) / m.pairs
            keep[ok], share[ok] = self.context(own)
            k, s = self.context(np.array([m.vocabulary]))
            start_keep, start_share = float(k[0]), float(s[0])
        base = np.log10((counts + 1) / (m.tokens + m.vocabulary + 1))
        first = np.cumsum(lens) - lens
        total, back = np.empty(len(ids)), np.empty(len(ids))
        total[1:], back[1:] = keep[inverse[:-1]], share[inverse[:-1]]
        total[first], back[first] = start_keep, start_share
        p = back * single[inverse]
        if m.vocabulary:
            prev = r.previous(ids, lens)
            both = np.flatnonzero(known & (prev <= m.vocabulary))
            keys = prev[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64)
            u, at = np.unique(keys, return_inverse=True)
            c = np.zeros(len(u))
            shards = _top(mix64(u), m.bits)
            order = np.argsort(shards, kind="stable")
            place, found = r.find("pair", u[order], shards[order])
            c[order] = self.counts(place, found, shards[order])
            c = c[at]
            seen = c > 0
            p[both[seen]] += (c[seen] - self.d2[np.minimum(c[seen], 3).astype(np.int64)]) / total[both[seen]]
        return lens, sums(known).astype(np.int64), sums(base[inverse]), sums(np.log10(p))

    def context(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total count of contexts, and the share they leave to single words."""
        r = self.reader
        total = r.gather("total", ids).astype(np.float64)
        rest = sum(self.d2[k] * r.gather(n, ids).astype(np.float64)
                   for k, n in ((1, "once"), (2, "twice"), (3, "more")))
        return total, np.where(total > 0, rest / np.maximum(total, 1), 1.0)

    def counts(self, place: np.ndarray, found: np.ndarray, shards: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place))
        cut = np.concatenate(([0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(place)])) if len(place) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            s = int(shards[a])
            ok = np.flatnonzero(found[a:b]) + a
            c = self.reader.file(f"few_{s}")[place[ok]].astype(np.float64)
            large = c == 255
            if large.any():
                at = np.searchsorted(self.reader.file(f"many_at_{s}"), place[ok][large])
                c[large] = self.reader.file(f"many_{s}")[at]
            out[ok] = c
        return out


def score_lm(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row.

    ``score`` is the log10 probability of the words and one end token, the
    first word following a start context; perplexity is
    ``10 ** (-score / n_tokens)``.  ``base_score`` adds one to each count of
    single tokens.  Null text counts as empty; null and repeated ids are
    passed through; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            got = [scorer.run(texts) for _, texts in text_runs(batch.column(1))]
            n, known, base, score = (np.concatenate(x) for x in zip(*got)) if got else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base, pa.float64()),
                 pa.array(score, pa.float64()), pa.array(10.0 ** (-score / np.maximum(n, 1)), pa.float64())],
                names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text_")).mapInArrow(
        work, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, perplexity double")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder``."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == remainder,
                      F.lit(False))
