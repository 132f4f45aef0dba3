"""Quality classifier: hashed word n-grams, logistic regression trained with
follow-the-regularised-leader updates, scored as sparse dot products.

A text becomes a stream of tokens: runs of word characters in lower case (a
marker before those written in capitals), runs of other signs, and a marker in
place of a token that repeats the one before it.  Features are the stream's
single tokens and pairs, hashed into ``2**bits`` places, with
``log(1 + count)`` as value, scaled to length one per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import CACHE_WORDS, mix64, pack, text_runs, unpack

BITS = 20
TOKEN = re.compile(r"\w+|[^\w\s]+")
_SEP, _AGAIN, _CAPS = (xxhash.xxh3_64_intdigest(x) for x in (b"\n", b"\n again", b"\n capitals"))


class Tokens(dict):
    """A run of non-space characters -> hashes of its tokens."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out: list[int] = []
        for t in TOKEN.findall(raw):
            if len(t) > 1 and t.isupper():
                out.append(_CAPS)
            out.append(xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")))
        hit = self[raw] = tuple(out)
        return hit


def features(texts: list[str], tokens: Tokens, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, place, value) of all features, sorted by text."""
    get = tokens.__getitem__
    flat = list(chain.from_iterable(chain.from_iterable((*map(get, t.split()), (_SEP,)) for t in texts)))
    h = np.array(flat, np.uint64)
    end = h == np.uint64(_SEP)
    doc = np.cumsum(end) - end
    same = np.concatenate(([False], h[1:] == h[:-1])) & ~end if len(h) else end
    h = np.where(same, np.uint64(_AGAIN), h)
    pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[~(end[:-1] | end[1:])]
    owner = np.concatenate((doc[~end], doc[:-1][~(end[:-1] | end[1:])])).astype(np.uint64)
    place = np.concatenate((mix64(h[~end]), pair)) >> np.uint64(64 - bits)
    key, count = np.unique(owner << np.uint64(bits) | place, return_counts=True)
    owner, place = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(texts)))
    return owner, place, value / norm[owner]


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.5,
               beta: float = 1.0, l1: float = 0.01, l2: float = 0.02, epochs: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept from (places, values, label) rows, in order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    for _ in range(epochs):
        for place, value, label in rows:
            at, x = np.append(place, bias), np.append(value, 1.0)
            w = _weights(z[at], n[at], alpha, beta, l1, l2)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = _weights(z, n, alpha, beta, l1, l2)
    return w[:bias].astype(np.float32), float(w[bias])


def _weights(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    max_rows: int, label: int | None = None, id_of: str | None = None) -> DataFrame:
    """(text_, y, k_) of at most ``max_rows`` labelled rows, the ones with the
    smallest hash of their id.  The sample's ids are bounded by ``max_rows``,
    hence the broadcast."""
    y = labels.select(F.col(f"`{id_of or id_col}`").alias("i_"), F.col(f"`{label_col}`").cast("int").alias("y")) \
        .where("i_ is not null and y is not null").dropDuplicates(["i_", "y"])
    if label is not None:
        y = y.where(F.col("y") == label)
    picked = y.withColumn("k_", F.xxhash64("i_")).orderBy("k_", "i_", "y").limit(max_rows)
    return docs.select(F.col(f"`{id_col}`").alias("i_"), F.col(f"`{text_col}`").alias("text_")) \
        .join(F.broadcast(picked), "i_")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_rows: int = 10_000, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_rows`` labelled rows (the bound of what comes to
    the driver, as hashed features).  Without labelled rows: weights 0."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for start, texts in text_runs(batch.column(0)):
                owner, place, value = features(texts, tokens, bits)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                blobs = [pack(place[a:b].astype(np.uint32), value[a:b].astype(np.float32))
                         for a, b in zip(ends[:-1], ends[1:])]
                own = [batch.column(c).slice(start, len(texts)) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *own], names=["x", "y", "k_"])

    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows).select("text_", "y", "k_")
    got = sorted(((r.k_, bytes(r.x), r.y) for r in sample.mapInArrow(work, "x binary, y int, k_ long").toLocalIterator()))
    rows = [(*unpack(x), y) for _, x, y in got]
    return train_ftrl([(p.astype(np.int64), v.astype(np.float64), y) for p, v, y in rows], bits)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """(id, score, predicted) per row: score is the probability of label 1.

    Null text counts as empty; a text without tokens has the intercept's
    score.  Null and repeated ids are passed through; other columns are
    ignored.  The weights (4 MB at 20 bits, whatever the input) are broadcast."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, bias), tokens = held.value, Tokens()
        for batch in batches:
            score = [np.zeros(0)]
            for _, texts in text_runs(batch.column(1)):
                owner, place, value = features(texts, tokens, bits)
                z = np.bincount(owner, weights=value * w[place], minlength=len(texts)) + bias
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            s = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32))],
                                             names=[id_col, "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text_")) \
        .mapInArrow(work, f"`{id_col}` {kind}, score double, predicted int")
