"""Helpers shared by the training-data operators: words, word hashes,
shingles, packed arrays and model files in the shared folder.

Words follow one rule everywhere: A-Z lower-cased, then maximal runs of
characters other than space, tab, LF, VT, FF and CR.  On UTF-8 bytes that is
``bytes.lower().split()``.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.session import scratch_path

# Texts are worked on in runs of about so many characters, so the word lists
# of a task stay small whatever the size of an Arrow batch.
RUN_CHARS = 1_500_000
# Words kept in a worker's hash cache before it starts anew.
CACHE_WORDS = 150_000

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling of an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHasher(dict):
    """word (bytes) -> 64-bit hash; forgets everything when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def flat(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words one after another, and the words of each text."""
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lens.sum())
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.uint64, total), lens


def text_runs(column: pa.Array, chars: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``chars`` bytes
    together, one row at least; nulls become empty texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(size):
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + chars, side="right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; texts are not told apart."""
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s += mix64(h[j: len(h) - k + 1 + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1)))
        s *= np.uint64(0xFF51AFD7ED558CCD)
    return mix64(s)


def shingle_hashes(h: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all k-word shingles and the text index of each.

    A text of 1..k-1 words has its whole sequence as its one shingle; a text
    without words has none."""
    starts = np.concatenate(([0], np.cumsum(lens)))
    s = kgrams(h, k)
    doc = np.repeat(np.arange(len(lens)), lens)[: len(s)]
    keep = np.arange(len(s)) + k <= starts[1:][doc] if len(s) else np.zeros(0, bool)
    s, doc = s[keep], doc[keep]
    short = np.flatnonzero((lens > 0) & (lens < k))
    if len(short):
        whole = [kgrams(h[starts[i]: starts[i + 1]], int(lens[i]))[0] for i in short]
        s = np.concatenate((s, np.array(whole, np.uint64)))
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        s, doc = s[order], doc[order]
    return s, doc


_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """One compressed blob of several arrays; bytes of equal weight lie
    together, so sorted differences and small numbers shrink."""
    head = struct.pack("<B", len(arrays))
    body = []
    for a in arrays:
        head += struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a))
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return head + _PACK.compress(b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    n, at, heads = blob[0], 1, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", blob, at)
        heads.append((np.dtype("<" + kind.decode()), size))
        at += 10
    body = np.frombuffer(_UNPACK.decompress(blob[at:]), np.uint8)
    out, at = [], 0
    for kind, size in heads:
        end = at + size * kind.itemsize
        out.append(np.ascontiguousarray(body[at:end].reshape(kind.itemsize, size).T).reshape(-1).view(kind))
        at = end
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` as an ordinary path, for
    files that workers map into memory.  The shared folder must be mounted on
    every machine (a ``file:`` URI or a plain path); otherwise ValueError."""
    uri = urlparse(scratch_path(spark, name))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"model files are memory-mapped: {uri.scheme}:// is no mounted folder")
    path = unquote(uri.path)
    os.makedirs(path, exist_ok=True)
    return path


def write_array(folder: str, name: str, a: np.ndarray) -> None:
    """Atomic write: a repeated task replaces the file by an equal one."""
    part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, os.path.join(folder, f"{name}.npy"))


def map_array(folder: str, name: str) -> np.ndarray:
    return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")


def total_bytes(df: DataFrame, text: str) -> int:
    """Size of a text column in bytes (one number comes back)."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
