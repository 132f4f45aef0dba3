"""Personal data: detected entities receive keyed surrogates.

Detection runs inside the tasks.  A surrogate is drawn from a keyed hash of
(type, canonical form, attempt) and keeps the type and the format: digits stay
digits, letters stay letters, separators and the case of each mention stay;
card numbers keep their check digit right, addresses of machines stay valid,
names keep gender and script.  So the same entity has the same surrogate in
every text (coreference), whatever its spelling.

Persons are found after one of the titles or as one of the given names listed
below, with the word that follows; every other mention of a name so found in
the same text, in any case, is the same entity.  A name outside the lists that
has no title anywhere in its text stays as it is.

Distinctness is checked in Spark over the table of distinct entities: where
two share a surrogate, or a surrogate is itself an original, all but the first
take their next attempt, until none collides.  Only those overridden attempts
travel back to the texts that hold such an entity.  From attempt TRIES on a
surrogate is longer than its original (an address of a machine: octets of any
length), so a full space of one format ends no later than that.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import text_runs
from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import ensure_checkpoint_dir

# Titles and given names that mark a person and a gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "госпожа", "Κυρία"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "Κύριος"]}
GIVEN = {"f": ["Anna", "Mary", "Maria", "Laura", "Julia", "Emma", "Sophie", "Claire", "Carmen", "Lucia", "Анна",
               "Мария", "Елена", "Ольга", "Μαρία", "Ελένη"],
         "m": ["John", "James", "Peter", "Thomas", "Michael", "Hans", "Pierre", "Jean", "Carlos", "Miguel", "Иван",
               "Пётр", "Сергей", "Алексей", "Γιώργος", "Νίκος"]}
# Syllables and endings that names are made of, by script.
SYLLABLES = {"LATIN": "ba be bi bo da de do fa fe ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te to va ve".split(),
             "CYRILLIC": "ба бе ва ве да де ка ла ле ли ма ме ми на не ра ре ри са се та те то за зе".split(),
             "GREEK": "βα δα δε κα λα λε λι μα με μι να νε ρα ρε ρι σα σε τα τε το".split()}
ENDINGS = {("LATIN", "f"): ["na", "lia", "ra"], ("LATIN", "m"): ["rt", "rn", "ld"], ("LATIN", "s"): ["son", "ler", "mann"],
           ("CYRILLIC", "f"): ["на", "ля", "ра"], ("CYRILLIC", "m"): ["н", "рт", "с"], ("CYRILLIC", "s"): ["нко", "вич"],
           ("GREEK", "f"): ["να", "ρια"], ("GREEK", "m"): ["νος", "ρης"], ("GREEK", "s"): ["ίδου", "άκη"]}

# Attempts in the format of the original, and the attempt at which none of the
# wider ones is expected to collide either.
TRIES, MOST = 4, 60
NAME_KINDS = ("given_f", "given_m", "surname")

_CAP = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
PATTERNS = [(kind, re.compile(p)) for kind, p in [
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    ("cloud_key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("password", r"(?<=password=)[^\s\"',;]{6,}|(?<=passwd=)[^\s\"',;]{6,}|(?<=pwd=)[^\s\"',;]{6,}"),
    ("token", r"(?<=token = \")[^\s\"]{16,}(?=\")|(?<=token=\")[^\s\"]{16,}(?=\")|(?<=api_key=\")[^\s\"]{16,}(?=\")"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("card", r"(?<![\w-])[3-6]\d{3}(?:([ -]?)\d{4}\1\d{4}\1\d{4}|([ -]?)\d{6}\2\d{5})(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
]]
_TITLED = re.compile(r"(?<!\w)(?:(?P<f>%s)|(?P<m>%s))\.? (?P<a>%s)(?: (?P<b>%s))?" % (
    "|".join(TITLES["f"]), "|".join(TITLES["m"]), _CAP, _CAP))
_NAMED = re.compile(r"(?<!\w)(?:(?P<f>%s)|(?P<m>%s))(?: (?P<b>%s))?(?!\w)" % (
    "|".join(GIVEN["f"]), "|".join(GIVEN["m"]), _CAP))
# A text without any of these has no entity; saves the patterns their work.
_HINT = re.compile(r"[@\d]|AKIA|passw|pwd=|token|api_key|" + "|".join(sorted(sum([*TITLES.values(), *GIVEN.values()], []))))
_TOKEN = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_KEPT = re.compile(r"[^\W_]")


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, type, canonical form) of entities, left to right and not
    overlapping; of overlapping ones the earlier in PATTERNS wins."""
    if not _HINT.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []  # in order, none overlapping

    def put(a: int, b: int, kind: str) -> None:
        at = bisect(taken, (a,))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, kind, canonical(kind, text[a:b])))
    for kind, rx in PATTERNS:
        for m in rx.finditer(text):
            put(m.start(), m.end(), kind)
    for m in _TITLED.finditer(text):
        gender = "f" if m["f"] else "m"
        if m["b"]:
            put(*m.span("a"), f"given_{gender}")
        put(*m.span("b" if m["b"] else "a"), "surname")
    for m in _NAMED.finditer(text):
        gender = "f" if m["f"] else "m"
        put(*m.span(gender), f"given_{gender}")
        if m["b"]:
            put(*m.span("b"), "surname")
    # Later and earlier mentions of the names found; of two kinds the first in the text.
    names: dict[str, str] = {}
    for _, _, kind, form in taken:
        if kind in NAME_KINDS:
            names.setdefault(form, kind)
    if names:
        for m in _TOKEN.finditer(text):
            kind = names.get(m[0].lower())
            if kind:
                put(*m.span(), kind)
    return taken


def canonical(kind: str, mention: str) -> str:
    """What spellings of one entity share."""
    if kind in ("phone", "card", "ssn", "iban"):
        return "".join(_KEPT.findall(mention)).upper()
    if kind in ("password", "token", "cloud_key"):
        return mention
    return mention.lower()


def _luhn(digits: str) -> int:
    """The digit that completes a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


class _Draw:
    """Numbers from a keyed hash, as many as are asked for."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.value = key, "\0".join(parts).encode("utf-8", "surrogatepass"), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 16:
            h = hashlib.blake2b(self.seed + b"%d" % self.block, key=self.key, digest_size=32).digest()
            self.value, self.left, self.block = int.from_bytes(h, "big"), 1 << 256, self.block + 1
        self.value, x = divmod(self.value, n)
        self.left //= n
        return x


def _like(text: str, draw: _Draw) -> str:
    """Digits for digits, letters for letters; hexadecimal stays so."""
    letters = "abcdef" if re.fullmatch(r"[0-9a-f]+", text) else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            x = letters[draw.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """Surrogate of a canonical form, itself in canonical form; from attempt
    TRIES on longer by one sign more with each attempt."""
    draw = _Draw(key, kind, form, str(attempt))
    extra = max(0, attempt - TRIES + 1)
    if kind == "email":
        local, _, domain = form.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(local + 'x' * extra, draw)}@{_like(host, draw)}.{top}"
    if kind == "ip" and extra:
        return ".".join(str(draw.below(256)) for _ in range(4))
    if kind == "ip":
        low = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        return ".".join(str(low[len(p)][0] + draw.below(low[len(p)][1] - low[len(p)][0] + 1)) for p in form.split("."))
    if kind == "card":
        body = form[0] + _like(form[1:-1] + "0" * extra, draw)
        return body + (str(_luhn(body)) if int(form[-1]) == _luhn(form[:-1]) else str(draw.below(10)))
    if kind == "phone":
        return form[0] + _like(form[1:] + "0" * extra, draw)
    if kind == "cloud_key":
        return form[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in range(len(form) - 4 + extra))
    if kind == "iban":
        return form[:2] + _like(form[2:] + "0" * extra, draw)
    if kind in ("given_f", "given_m", "surname"):
        script = unicodedata.name(form[0], "LATIN").split()[0]
        script = script if script in SYLLABLES else "LATIN"
        ends = ENDINGS[script, kind[-1] if kind != "surname" else "s"]
        parts = SYLLABLES[script]
        body = "".join(parts[draw.below(len(parts))] for _ in range(2 + attempt // 4 + draw.below(2)))
        return body + ends[draw.below(len(ends))]
    return _like(form + ("0" if kind == "ssn" else "x") * extra, draw)


def render(kind: str, mention: str, new: str) -> str:
    """Write a canonical surrogate the way the mention is written."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return _KEPT.sub(lambda m: next(chars), mention) + "".join(chars)
    if kind in ("password", "token", "cloud_key"):
        return new
    if kind == "email" and len(new) == len(mention):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new))
    if mention.isupper() and len(mention) > 1:
        return new.upper()
    return new.title() if mention[:1].isupper() and kind != "email" else new


def _entities(rows: DataFrame) -> DataFrame:
    """(rk, kind, form): distinct entities of each text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_runs(batch.column(1), 2_000_000):
                out = []
                for key, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts):
                    out += [(key, k, f) for k, f in {(k, f) for _, _, k, f in detect(text)}]
                rk, kind, form = zip(*out) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(kind, pa.string()),
                                                  pa.array(form, pa.string())], names=["rk", "kind", "form"])
    return rows.select("rk", "text_").mapInArrow(work, "rk long, kind string, form string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt, new) for (kind, form, attempt)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, form, attempt = (c.to_pylist() for c in b.columns)
            new = [surrogate(k, f, n, key) for k, f, n in zip(kind, form, attempt)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())],
                                             names=["kind", "form", "attempt", "new"])
    return entities.select("kind", "form", "attempt").mapInArrow(
        work, "kind string, form string, attempt int, new string")


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt, new) with distinct ``new`` per kind, none of
    which is a form of that kind.  ``entities`` has distinct (kind, form).
    ValueError if attempt MOST still collides: the space is full (more
    addresses of machines than there are)."""
    now = _drawn(entities.withColumn("attempt", F.lit(0)), key).checkpoint()
    forms = now.select("kind", F.col("form").alias("new"), F.lit(True).alias("taken"))
    for attempt in range(MOST + 1):
        first = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "form")).alias("own"), F.count(F.lit(1)).alias("c"))
        bad = first.join(forms, ["kind", "new"], "left").where("c > 1 or taken")
        again = now.join(bad, ["kind", "new"]).where(
            F.col("taken") | (F.col("form") != F.col("own.form"))).select("kind", "form").checkpoint()
        if again.isEmpty():
            return now
        if attempt == MOST:
            break
        moved = now.join(again, ["kind", "form"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = now.join(again, ["kind", "form"], "left_anti").union(_drawn(moved, key)).checkpoint()
    raise ValueError(f"{again.count()} entities have no free surrogate after {MOST} attempts")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_entities, kinds array<string>, text): the text with every
    detected entity replaced.

    Null text stays null and has no entity; empty texts stay empty.  Null and
    repeated ids are passed through, one row each; equal texts get equal
    replacements.  Other columns are ignored."""
    ensure_checkpoint_dir(docs.sparkSession)
    secret = hashlib.sha256(key.encode()).digest()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text_"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("rk"))
    found = _entities(rows).distinct().checkpoint()
    new = assign_surrogates(found.select("kind", "form").distinct(), secret)
    moved = found.join(new.where("attempt > 0"), ["kind", "form"]).groupBy("rk").agg(
        F.collect_list(F.struct("kind", "form", "attempt")).alias("moved"))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at, moved_at = batch.column(1), batch.column(2)
            for start, texts in text_runs(text_at, 2_000_000):
                count, kinds, out = [], [], []
                own = moved_at.slice(start, len(texts)).to_pylist()
                for text, over, null in zip(texts, own, text_at.slice(start, len(texts)).is_null().to_pylist()):
                    attempts = {(m["kind"], m["form"]): m["attempt"] for m in over or ()}
                    spans = detect(text)
                    parts, at = [], 0
                    for a, b, k, form in spans:
                        name = surrogate(k, form, attempts.get((k, form), 0), secret)
                        parts += [text[at:a], render(k, text[a:b], name)]
                        at = b
                    parts.append(text[at:])
                    count.append(len(spans))
                    kinds.append(sorted({k for _, _, k, _ in spans}))
                    out.append(None if null else "".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(count, pa.int64()),
                     pa.array(kinds, pa.list_(pa.string())), pa.array(out, pa.string())],
                    names=[id_col, "n_entities", "kinds", "text"])

    return rows.join(broadcast_if_small(moved, 32 << 20), "rk", "left") \
        .select(F.col(f"`{id_col}`"), "text_", "moved") \
        .mapInArrow(work, f"`{id_col}` {kind}, n_entities long, kinds array<string>, text string")
