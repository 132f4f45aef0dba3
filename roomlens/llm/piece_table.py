"""SentencePiece (merge-type) encoding and decoding by a prefix table.

For every prefix of a text the merge-type encoding has one last token, and
the encoding of the whole text can be read backwards along those tokens.  The
table is filled from left to right: an automaton over the vocabulary lists
the tokens that end at a position, longest first, and the first that is
*compatible* with the last token of the prefix before it is the one.  Two
tokens are compatible when merging their joined characters by the
vocabulary's scores gives exactly these two tokens.

No token of the vocabulary has a space mark after another character or holds a
line end (this is tested when a model is read), so a text falls apart before
each run of space marks and each line end, and equal units have equal
encodings: a worker keeps the ids of units it has seen in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import text_runs

# Fixed values of the model format: kinds of pieces and the space mark.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
# Units kept in each of a worker's two generations: about 120 bytes each.
CACHE = 300_000


class PieceTable:
    """Encoder and decoder of one merge-type model file."""

    def __init__(self, model_file: str, cache: int = CACHE):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        self.cache = cache
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces \
                or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with identity normalisation is needed")
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not handled")
        self.dummy = rules.add_dummy_prefix
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.unk_surface = model.trainer_spec.unk_surface
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.unk = next(i for i, t in enumerate(self.kinds) if t == UNKNOWN)
        self.eos = self.pieces.index(model.trainer_spec.eos_piece or "</s>")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.kinds)) if t == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.kinds)) if t == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        letters = {c for p in self.ids for c in p}
        if not letters <= set(self.ids):
            raise ValueError("a piece has a character that is no piece")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or "\n" in letters:
            raise ValueError("a piece crosses a space mark or a line end")
        self.units = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        # Tokens that their own characters do not merge into can never appear.
        self.auto = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:
                self.auto.add_word(piece, piece)
        self.auto.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text: best score first, leftmost
        among equals.  Used on one token or two joined ones only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = left not in self.score or self.merged(left + right) == [left, right]
        if len(self.pairs) >= self.cache:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def split(self, unit: str) -> list[str]:
        """Tokens of one unit; a character outside the vocabulary is a token
        by itself, which merges with nothing.  The automaton lists the tokens
        that end at one place longest first."""
        last: list[str] = []
        known = self.pairs.get
        for end, piece in self.auto.iter(unit):
            if end < len(last):
                continue
            while len(last) < end:
                last.append(unit[len(last)])
            before = end - len(piece)
            if before >= 0:
                ok = known((last[before], piece))
                if ok is None:
                    ok = self.compatible(last[before], piece)
                if not ok:
                    continue
            last.append(piece)
        while len(last) < len(unit):
            last.append(unit[len(last)])
        out, i = [], len(unit) - 1
        while i >= 0:
            token = last[i]
            out.append(token)
            i -= len(token)
        out.reverse()
        return out

    def unit_ids(self, unit: str) -> list[int]:
        ids: list[int] = []
        for token in self.split(unit):
            one = self.ids.get(token)
            if one is not None:
                ids.append(one)
            elif self.byte_fallback:
                ids += [self.bytes[b] for b in token.encode("utf-8")]
            elif not ids or ids[-1] != self.unk:  # a run of unknowns is one
                ids.append(self.unk)
        return ids

    def seen(self, key: str) -> str:
        """Decimal ids of a unit.  The key is the unit without its space mark
        where it has exactly one; other units, with none or several, are
        given as they are.  Two generations of seen units are kept."""
        hit = self.old.get(key)
        if hit is None:
            unit = key if key[:1] in (SPACE, "\n") else SPACE + key
            ids = self.unit_ids(unit)
            hit = " ".join(map(str, ids))
            shown = self.pieces_text(ids)
            if shown != unit.replace(SPACE, " "):
                self.odd[key] = shown
        if len(key) <= 64:
            if len(self.young) >= self.cache:
                self.old, self.young = self.young, {}
            self.young[key] = hit
        return hit

    def digest_parts(self, text: str) -> tuple[str, int, str]:
        """(ids with the end id, joined by a space; their number; decoded).

        A piece holds no line end and no space mark after another character,
        so units between those are encoded one by one."""
        if not text:
            return str(self.eos), 1, ""
        if self.dummy and text[0] != " " and "  " not in text and " \n" not in text and text[0] != "\n" \
                and SPACE not in text:
            keys = text.replace("\n", " \n").split(" ")
        else:
            marked = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
            keys = [u[1:] if u[0] == SPACE and u[1:2] != SPACE else u for u in self.units.findall(marked)]
            if marked[0] not in (SPACE, "\n"):  # an unmarked first unit
                return self.whole(marked)
        get, seen = self.young.get, self.seen
        found = [get(k) or seen(k) for k in keys]
        found.append(str(self.eos))
        ids = " ".join(found)
        if self.odd and any(k in self.odd for k in keys):
            return self.whole((SPACE if self.dummy else "") + text.replace(" ", SPACE))
        # Every unit was decoded from its ids when it was first seen.
        shown = text.replace(SPACE, " ") if SPACE in text else text
        return ids, ids.count(" ") + 1, shown

    def whole(self, marked: str) -> tuple[str, int, str]:
        ids = self.unit_ids(marked) + [self.eos]
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.digest_parts(text)[0].split()]

    def pieces_text(self, ids: list[int]) -> str:
        """decode() without dropping the first space."""
        return self.decode(ids, keep_first=True)

    def decode(self, ids: list[int], keep_first: bool = False) -> str:
        """Text of ids: control ids vanish, byte ids join to UTF-8 with the
        replacement character for bytes that are none."""
        out: list[str] = []
        raw = bytearray()
        value = self.values
        first = self.dummy and not keep_first
        for i in ids:
            if i in value:
                raw.append(value[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                first = False
            if self.kinds[i] == CONTROL:
                continue
            piece = self.unk_surface if self.kinds[i] == UNKNOWN else self.pieces[i]
            if first and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out) + _utf8(bytes(raw))


def _utf8(raw: bytes) -> str:
    """One replacement character for each byte that begins no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode("utf-8") + "�")
            raw = raw[e.start + 1:]
    return "".join(out)


_TABLES: dict[tuple[str, int], PieceTable] = {}


def table_of(model_file: str, cache: int = CACHE) -> PieceTable:
    """One table per worker process, model file and cache size."""
    if (model_file, cache) not in _TABLES:
        _TABLES[model_file, cache] = PieceTable(model_file, cache)
    return _TABLES[model_file, cache]


def piece_encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False, with_text: bool = False, cache: int = CACHE) -> DataFrame:
    """Encode every whole text with an end id and decode it again.

    Returns id, n_tokens, ids_sha256 (decimal ids joined by one space) and
    decoded_sha256 (UTF-8), and with ``with_ids`` / ``with_text`` also
    ``ids array<int>`` and ``decoded``.  ``model_file`` is read by each worker and must be
    installed on every machine.  ``cache`` is the number of units that a
    worker keeps in each of two generations; it changes no result.

    Null text counts as empty, whose one id is the end id and whose decoded
    text is empty.  Null and repeated ids are passed through, one row each.
    Other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" \
        + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file, cache)
        for batch in batches:
            for start, texts in text_runs(batch.column(1), 1_000_000):
                n, a, b, c, d = [], [], [], [], []
                for text in texts:
                    ids, count, decoded = table.digest_parts(text)
                    n.append(count)
                    a.append(hashlib.sha256(ids.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        c.append(np.fromstring(ids, np.int32, sep=" "))
                    if with_text:
                        d.append(decoded)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()),
                     pa.array(a, pa.string()), pa.array(b, pa.string())]
                    + [pa.array(c, pa.list_(pa.int32()))] * with_ids + [pa.array(d, pa.string())] * with_text,
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
                    + ["decoded"] * with_text)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text_")).mapInArrow(work, schema)
