"""Toxic spans by a linear-chain conditional random field.

Tags are "clean" and "toxic"; a token's features are its word and the word's
first letters, a chain is a line (cut every 256 tokens).  The tables label
whole texts, so token labels are derived first: in a toxic text, a token is
labelled toxic if one of its features is far more frequent in toxic texts than
in clean ones; all tokens of clean texts are labelled clean.  The field is then
trained on these labelled tokens by gradient steps on its log-likelihood.

Forward-backward marginals give each token its probability of being toxic;
those add up to a text's score and mark the offending offsets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import CACHE_WORDS, WordHasher, mix64, shingle_hashes, text_runs, words_of
from roomlens.llm.quality import labelled_sample
from roomlens.session import ensure_checkpoint_dir

BITS = 18
CHAIN = 256
PREFIXES = (4, 5, 6, 7)
RAW = re.compile(r"\S+")
SIGNS = re.compile(r"\W+")


def token_features(raw: str) -> list[int]:
    """Places of a token's features; a token without letters has none."""
    word = SIGNS.sub("", raw.lower())
    if not word:
        return []
    names = [word] + [f"{word[:n]}\n" for n in PREFIXES if len(word) > n]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> (64 - BITS) for x in names]


def chains(text: str) -> list[list[str]]:
    out = []
    for line in text.split("\n"):
        raw = line.split()
        out += [raw[i:i + CHAIN] for i in range(0, len(raw), CHAIN)]
    return out


@dataclass
class Field:
    """Weights of a two-tag field: feature weights (toxic against clean),
    log potentials of moves between tags and of the first tag; ``text`` turns
    the marginals of a text into its score."""
    weight: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    text: np.ndarray = field(default_factory=lambda: np.array([-2.0, 2.0, 2.0]))


def marginals(e: np.ndarray, lens: np.ndarray, crf: Field, expect: bool = False):
    """P(toxic) of each token of many chains (token scores ``e`` one chain
    after another), by scaled forward-backward steps over all chains at once.
    With ``expect`` also the expected numbers of moves and of first tags, and
    the chains' total log-normaliser."""
    a = np.exp(crf.moves)
    f = np.exp(np.clip(e, -30, 30))
    order = np.argsort(-lens, kind="stable")
    start = (np.cumsum(lens) - lens)[order]
    size = lens[order]
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t)) for t in range(steps)]  # chains longer than t
    fwd, back, out = np.empty_like(f), np.empty_like(f), np.empty_like(f)
    log_z = 0.0
    for t in range(steps):
        at = start[: active[t]] + t
        if t:
            p = fwd[at - 1]
            toxic, clean = (1 - p) * a[0, 1] + p * a[1, 1], (1 - p) * a[0, 0] + p * a[1, 0]
        else:
            toxic, clean = np.exp(crf.first[1]), np.exp(crf.first[0])
        toxic = toxic * f[at]
        fwd[at] = toxic / (toxic + clean)
        if expect:
            log_z += float(np.log(toxic + clean).sum())
    moves, first = np.zeros((2, 2)), np.zeros(2)
    for t in range(steps - 1, -1, -1):
        at = start[: active[t]] + t
        b = np.full(len(at), 0.5)
        k = active[t + 1] if t + 1 < steps else 0
        if k:
            nxt = at[:k] + 1
            bt, bc = back[nxt] * f[nxt], 1 - back[nxt]
            toxic, clean = a[1, 0] * bc + a[1, 1] * bt, a[0, 0] * bc + a[0, 1] * bt
            b[:k] = toxic / (toxic + clean)
            if expect:
                p = fwd[at[:k]]
                cells = [[(1 - p) * a[0, 0] * bc, (1 - p) * a[0, 1] * bt], [p * a[1, 0] * bc, p * a[1, 1] * bt]]
                z = sum(c for row in cells for c in row)
                moves += [[float((c / z).sum()) for c in row] for row in cells]
        back[at] = b
        p = fwd[at]
        out[at] = p * b / (p * b + (1 - p) * (1 - b))
    if expect and steps:
        m = out[start[: active[0]]]
        first += [float((1 - m).sum()), float(m.sum())]
    return (out, moves, first, log_z) if expect else out


def marking_features(rows: DataFrame, least: float = 12.0) -> set[int]:
    """Features that mark toxic tokens, from (text_, y) rows: those more
    frequent in toxic texts whose counts by label are unlikely under equal
    rates (log-likelihood ratio above ``least``).  Texts are counted on the
    executors, one row per feature, label and task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [Counter(), Counter()]
        memo: dict[str, list[int]] = {}
        for batch in batches:
            for start, texts in text_runs(batch.column(0)):
                for text, y in zip(texts, batch.column(1).slice(start, len(texts)).to_pylist()):
                    seen = {-1}
                    for raw in set(text.split()):
                        if raw not in memo:
                            if len(memo) >= CACHE_WORDS:
                                memo.clear()
                            memo[raw] = token_features(raw)
                        seen.update(memo[raw])
                    count[y].update(seen)
        for y, c in enumerate(count):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32()), pa.array([y] * len(c), pa.int32()),
                                              pa.array(list(c.values()), pa.int64())], names=["f", "y", "c"])

    count = rows.select("text_", "y").mapInArrow(work, "f int, y int, c long").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("c")).where("t > 2 or f < 0")
    got = count.collect()  # 2**BITS rows at most
    toxic, clean = next(((r.t, r.c) for r in got if r.f < 0), (0, 0))
    if not toxic or not clean:
        return set()
    out = set()
    for f, t, c in got:
        rate = (t + c) / (toxic + clean)
        g = t * np.log(t / (toxic * rate)) + (c * np.log(c / (clean * rate)) if c else 0.0) if f >= 0 else 0.0
        if g > least and t * clean > 10 * c * toxic:
            out.add(f)
    return out


def varied(marked: set[int], toxic: list[str], share: float = 0.6) -> set[int]:
    """The marking features whose occurrences have different neighbours; words
    of a passage that several texts share always have the same ones."""
    around: dict[int, set] = {}
    texts: Counter = Counter()
    memo: dict[str, list[int]] = {}
    for text in toxic:
        raw = ["", *text.split(), ""]
        seen = set()
        for i, r in enumerate(raw):
            if r not in memo:
                memo[r] = [f for f in token_features(r) if f in marked]
            for f in memo[r]:
                around.setdefault(f, set()).add((raw[i - 1], raw[i + 1]))
                seen.add(f)
        texts.update(seen)
    return {f for f, n in texts.items() if len(around[f]) >= max(2, share * n)}


def fit_field(texts: list[tuple[str, int]], marked: set[int], rounds: int = 30, rate: float = 1.0) -> Field:
    """Train on (text, label) rows; ``marked`` features label the tokens of
    toxic texts.  Without any, every token is clean."""
    lists, tags = [], []
    memo: dict[str, list[int]] = {}
    for text, y in texts:
        for chain in chains(text):
            for raw in chain:
                if raw not in memo:
                    memo[raw] = token_features(raw)
            got = [memo[raw] for raw in chain]
            tag = [bool(y) and any(f in marked for f in fs) for fs in got]
            if any(tag) or not y:  # the rest of a toxic text says nothing about its tokens
                lists.append(got)
                tags.append(tag)
    crf = Field(np.zeros(1 << BITS), np.zeros((2, 2)), np.zeros(2))
    if not lists or not marked:
        crf.first[1] = crf.moves[0, 1] = crf.moves[1, 1] = -12.0
        return crf
    lens = np.array([len(x) for x in lists])
    flat = [fs for x in lists for fs in x]
    token = np.repeat(np.arange(len(flat)), [len(fs) for fs in flat])
    place = np.array([f for fs in flat for f in fs], np.int64)
    y = np.array([t for x in tags for t in x], np.float64)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lens) - lens] = False
    now, was = y[inner].astype(int), y[np.flatnonzero(inner) - 1].astype(int)
    seen_moves = np.array([[((was == i) & (now == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    head = y[~inner]
    seen_first = np.array([(1 - head).sum(), head.sum()])
    g2 = [np.full(x.shape, 1e-6) for x in (crf.weight, crf.moves, crf.first)]
    for _ in range(rounds):
        e = np.bincount(token, weights=crf.weight[place], minlength=len(y))
        m, moves, first, _ = marginals(e, lens, crf, expect=True)
        grads = [np.bincount(place, weights=(y - m)[token], minlength=1 << BITS) - 0.1 * crf.weight,
                 seen_moves - moves - 0.1 * crf.moves, seen_first - first - 0.1 * crf.first]
        for x, g, s in zip((crf.weight, crf.moves, crf.first), grads, g2):
            s += g * g
            x += rate * g / np.sqrt(s)
    return crf


def without_copies(rows: DataFrame) -> DataFrame:
    """(i_, y) of (i_, text_, y) rows, one of a group of near copies: rows
    that share one of three least shingle hashes count as copies.  Otherwise
    each word of a copied toxic text would look like a toxic word."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            least = []
            for _, texts in text_runs(batch.column(2)):
                s, doc = shingle_hashes(*hasher.flat([words_of(t) for t in texts]), 5)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                for a, b in zip(ends[:-1], ends[1:]):
                    least.append([int(mix64(s[a:b] + np.uint64(k)).min() >> np.uint64(1)) if b > a else k
                                  for k in range(3)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in
                                              (zip(*least) if least else [[]] * 3)]], names=["i_", "y", "m0", "m1", "m2"])

    kind = rows.schema["i_"].dataType.simpleString()
    left = rows.select("i_", "y", "text_").mapInArrow(work, f"i_ {kind}, y int, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        left = left.groupBy(m).agg(F.min(F.struct("i_", "y", *[c for c in ("m0", "m1", "m2") if c != m])).alias("x")) \
            .select(m, "x.*")
    return left.select("i_", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", max_rows: int = 30_000, max_chains: int = 2000) -> Field:
    """Token labels come from at most ``max_rows`` labelled texts, counted on
    the executors; the field is trained on the driver on at most
    ``max_chains`` texts of each label, the bound of what comes there: half of
    them train the field, the other half the score of a text."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows)
    kept = without_copies(rows).select("i_", F.col("y").alias(label_col)).checkpoint()  # max_rows rows at most
    marked = marking_features(labelled_sample(docs, kept, id_col, text_col, label_col, max_rows, id_of="i_"))
    texts = []
    for label in (1, 0):
        sample = labelled_sample(docs, kept, id_col, text_col, label_col, max_chains, label, "i_")
        texts += [(t, label) for _, t in sorted((r.k_, r.text_ or "") for r in sample.toLocalIterator())]
    crf = fit_field(texts[::2], varied(marked, [t for t, y in texts if y]))
    share = dict(kept.groupBy(label_col).count().collect())
    crf.text = fit_text_score(texts[1::2] or texts, crf, share)
    return crf


def fit_text_score(texts: list[tuple[str, int]], crf: Field, share: dict[int, int], ridge: float = 0.3) -> np.ndarray:
    """Logistic weights over a text's evidence, by Newton steps; rows are
    weighted so that the labels count as often as ``share`` says."""
    y = np.array([label for _, label in texts], np.float64)
    if not y.any() or y.all():
        return Field(crf.weight, crf.moves, crf.first).text
    scores = Scores(crf)
    x = np.concatenate([evidence([t], crf, scores)[0] for t, _ in texts])
    weight = np.where(y == 1, share.get(1, 1) / y.sum(), share.get(0, 1) / (1 - y).sum())
    weight *= len(y) / weight.sum()
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scores(dict):
    """Raw token -> its score in the field."""

    def __init__(self, field: Field):
        super().__init__()
        self.weight = field.weight

    def __missing__(self, raw: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        hit = self[raw] = float(sum(self.weight[f] for f in token_features(raw)))
        return hit


def spans_of(text: str, toxic: np.ndarray) -> list[dict]:
    """Character offsets of runs of toxic tokens, in the original text."""
    out: list[dict] = []
    before = False
    for hit, m in zip(toxic.tolist(), RAW.finditer(text)):
        if hit and before:
            out[-1]["stop"] = m.end()
        elif hit:
            out.append({"start": m.start(), "stop": m.end()})
        before = hit
    return out


def evidence(texts: list[str], crf: Field, scores: Scores):
    """Per text: 1, log(1 + expected toxic tokens), highest marginal; and the
    marginals of all tokens with the tokens per text.  Marginals under 0.1 do
    not add up, however long the text."""
    get = scores.__getitem__
    lists = [chains(t) for t in texts]
    lens = np.array([len(c) for cs in lists for c in cs], np.int64)
    e = np.fromiter((get(raw) for cs in lists for c in cs for raw in c), np.float64, int(lens.sum()))
    m = marginals(e, lens, crf)
    size = np.array([sum(map(len, cs)) for cs in lists], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, m)
    total = np.bincount(owner, weights=np.where(m >= 0.1, m, 0.0), minlength=len(texts))
    return np.stack([np.ones(len(texts)), np.log1p(total), top], axis=1), m, size


def score_texts(texts: list[str], crf: Field, scores: Scores):
    """Per text its score, its toxic tokens and their spans."""
    x, m, size = evidence(texts, crf, scores)
    score = 1 / (1 + np.exp(-np.clip(x @ crf.text, -30, 30)))
    ends = np.cumsum(size)
    hot = m >= 0.5
    hits = np.bincount(np.repeat(np.arange(len(texts)), size)[hot], minlength=len(texts))
    spans = [spans_of(t, hot[b - s: b]) if n else [] for t, n, b, s in zip(texts, hits, ends, size)]
    return score, hits, spans


def _scored(rows: DataFrame, crf: Field, threshold: float) -> DataFrame:
    """(row_, score, predicted, toxic_tokens, spans) of (row_, text_) rows."""
    kind = rows.schema["row_"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(crf)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        scores = Scores(own)
        for batch in batches:
            for start, texts in text_runs(batch.column(1), 1_000_000):
                score, hits, spans = score_texts(texts, own, scores)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(score, pa.float64()),
                     pa.array((score >= threshold).astype(np.int32)), pa.array(hits, pa.int64()), pa.array(spans, span)],
                    names=["row_", "score", "predicted", "toxic_tokens", "spans"])

    return rows.mapInArrow(work, f"row_ {kind}, score double, predicted int, toxic_tokens long, "
                                 "spans array<struct<start:int,stop:int>>")


def score_toxicity(docs: DataFrame, crf: Field, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted, toxic_tokens, spans array<struct<start,stop>>) per row.

    Null and empty texts have the score of no evidence.  Null and repeated
    ids are passed through; other columns are ignored.  The field (2 MB,
    whatever the input) is broadcast."""
    rows = docs.select(F.col(f"`{id_col}`").alias("row_"), F.col(f"`{text_col}`").alias("text_"))
    return _scored(rows, crf, threshold).withColumnRenamed("row_", id_col)


def without_toxic(docs: DataFrame, crf: Field, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    rows = docs.select(F.struct("*").alias("row_"), F.col(f"`{text_col}`").alias("text_"))
    return _scored(rows, crf, threshold).where("predicted = 0").select("row_.*")
