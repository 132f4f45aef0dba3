"""Plain single-machine versions of the operators' rules, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

WORDS = "the of and in to that was for river stone light house garden paper winter morning table letter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 400)) if rng.random() < 0.6 else "") for _ in range(n))


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def components(nodes, links):
    """node -> smallest node reachable."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(rows, percent=75):
    sets = {d: shingles(t) for d, t in rows}
    post = {}
    for d, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(d)
    both = {}
    for ds in post.values():
        for a, b in itertools.combinations(sorted(ds), 2):
            both[a, b] = both.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return sorted((d, len(sets[d]), comp[d]) for d in sets)


def contaminated(docs, items, k=5, at_least=0.75):
    """doc -> {item: best similarity over its item-sized windows}."""
    def grams(w, g):
        return {tuple(w[i:i + g]) for i in range(len(w) - g + 1)}
    listed = [(i, words(t)) for i, t in items if words(t)]
    df = {}
    for _, w in listed:
        for g in grams(w, min(k, len(w))):
            df[g] = df.get(g, 0) + 1
    weight = lambda s: sum(math.log1p(len(listed) / df.get(g, 1)) for g in s)
    out = {}
    for d, t in docs:
        dw = words(t)
        best = {}
        for i, w in listed:
            n, g = len(w), min(k, len(w))
            size, own = min(n, len(dw)), grams(w, g)
            for a in range(len(dw) - size + 1):
                win = grams(dw[a:a + size], g)
                if win & own:
                    s = weight(win & own) / weight(win | own)
                    if s >= at_least - 1e-12:
                        best[i] = max(best.get(i, 0), s)
        out[d] = best
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney bigrams over {text}, in plain counts."""

    def __init__(self, texts):
        from collections import Counter
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = [*words(t), "END"]
            self.c1.update(w)
            self.c2.update(zip(["START", *w], w))
        self.before = Counter(v for _, v in self.c2)
        self.tokens, self.v = sum(self.c1.values()), len(self.c1)
        self.d2, self.d1 = self.discount(self.c2.values()), self.discount(self.before.values())

    @staticmethod
    def discount(values):
        n = [sum(v == k for v in values) for k in range(1, 5)]
        if not n[0]:
            return [0, 0, 0, 0]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y, 0), k) for k in (1, 2, 3)]

    def single(self, w):
        types = len(self.c2)
        left = sum(self.d1[min(b, 3)] for b in self.before.values()) / types
        b = self.before.get(w, 0)
        return (b - self.d1[min(b, 3)]) / types + left / (self.v + 1)

    def p(self, u, w):
        after = [c for (a, _), c in self.c2.items() if a == u]
        if not after:
            return self.single(w)
        c = self.c2.get((u, w), 0)
        share = sum(self.d2[min(x, 3)] for x in after) / sum(after)
        return (c - self.d2[min(c, 3)]) / sum(after) + share * self.single(w)

    def score(self, text):
        import math
        w = [*words(text), "END"]
        return sum(math.log10(self.p(u, x)) for u, x in zip(["START", *w], w))

    def base(self, text):
        import math
        return sum(math.log10((self.c1.get(w, 0) + 1) / (self.tokens + self.v + 1)) for w in [*words(text), "END"])


def near_vectors(rows, cosine=0.95):
    """(id, n_links, component, kept) by all pairs."""
    import numpy as np
    ids = [i for i, _ in rows]
    good = [(i, np.array(v, float)) for i, v in rows
            if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    links = []
    for d in {len(v) for _, v in good}:
        own = [(i, v) for i, v in good if len(v) == d]
        u = np.stack([(v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for _, v in own])
        for a in range(len(own)):
            for b in np.flatnonzero(u[a] @ u[a + 1:].T >= cosine).tolist():
                links.append((own[a][0], own[a + 1 + b][0]))
    n = dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components(ids, links)
    return sorted((i, n[i], comp[i], comp[i] == i) for i in ids)


_MASK = 2 ** 64 - 1


def xx64(text, seed=42):
    """The hash that Spark's xxhash64 gives a string."""
    import xxhash
    return xxhash.xxh64_intdigest(text.encode(), seed=seed)


def normal_line(line):
    import re
    import unicodedata
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in line.lower())
    return re.sub(" +", " ", kept).strip(" ")


def simhash(line):
    hashes = [xx64(w) for w in set(line.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within_radius(lines, similarity=0.75, radius=3):
    """Pairs of lines within the Hamming distance and the edit similarity."""
    fp = {n: simhash(n) for n in lines}
    return [(a, b) for a, b in itertools.combinations(lines, 2) if (fp[a] ^ fp[b]).bit_count() <= radius
            and edits(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9)]


def all_alike(lines, similarity=0.75):
    """Pairs of lines of that edit similarity, from all pairs.  Lines of n
    characters within k edits share n - 2 - 3k three-letter runs at least;
    those that do are compared by a database, in which every character is made
    a byte first, as it counts bytes."""
    import duckdb
    import numpy as np
    import pandas as pd
    code = {c: chr(33 + i) for i, c in enumerate(sorted({c for n in lines for c in n}))}
    assert len(code) < 94
    size = np.array([len(n) for n in lines])
    runs = [collections.Counter(n[i:i + 3] for i in range(len(n) - 2)) for n in lines]
    place = {r: i for i, r in enumerate(sorted({r for c in runs for r in c}))}
    counts = np.zeros((len(lines), len(place)), np.uint16)
    for i, c in enumerate(runs):
        counts[i, [place[r] for r in c]] = list(c.values())
    pairs = []
    for i in range(len(lines) - 1):
        most = np.maximum(size[i], size[i + 1:])
        allowed = np.floor((1 - similarity) * most + 1e-9)
        js = np.flatnonzero(np.abs(size[i + 1:] - size[i]) <= allowed)
        need = most[js] - 2 - 3 * allowed[js]
        own = np.flatnonzero(counts[i])
        common = np.minimum(counts[np.ix_(i + 1 + js, own)], counts[i, own]).sum(1)
        pairs += [(i, int(i + 1 + j), int(allowed[j])) for j in js[common >= need]]
    text = ["".join(map(code.get, n)) for n in lines]
    df = pd.DataFrame([(i, j, k, text[i], text[j]) for i, j, k in pairs], columns=["i", "j", "k", "x", "y"])
    found = duckdb.connect().execute("select i, j from df where levenshtein(x, y) <= k").fetchall()
    return [(lines[i], lines[j]) for i, j in found]


def deduped(rows, alike=within_radius):
    """[(id, text after, dropped lines)] of (id, text) rows with distinct ids."""
    where = {}
    for d, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            n = normal_line(line)
            if n:
                where.setdefault(n, []).append((d, p))
    lines = sorted(where)
    comp = components(lines, alike(lines))
    groups = {}
    for n in lines:
        groups.setdefault(comp[n], []).extend(where[n])
    gone = {o for g in groups.values() for o in g if o != min(g)}
    out = []
    for d, t in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if (d, p) not in gone]
        out.append((d, t if t is None else "\n".join(kept), sum(1 for x in gone if x[0] == d)))
    return out


def edited_texts(rows):
    """[(id, text, edited, next text)] of distinct rows in order of id."""
    rows = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    out = []
    for k, (some, i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        h = len(t) // 2
        out.append((i if some else None, t, t[: len(t) - h] + after[:h], after))
    return out


def pair_likeness(a, b):
    """Dice of the counts of (word, next word in the line)."""
    def count(t):
        out = collections.Counter()
        for line in t.split("\n"):
            w = line.split()
            out.update(zip(w, [*w[1:], None]))
        return out
    x, y = count(a), count(b)
    squares = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 2 * sum(v * y[k] for k, v in x.items()) / squares if squares else float(a == b)


def negatives(rows, positives=5, k=10, low=30, high=90):
    """rows of (id, vector, label), all distinct."""
    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows]
    out = []
    for i, l, v in rows:
        if i % 100:
            continue
        score = [sum(x * y for x, y in zip(v, r[2])) if len(v) == len(r[2]) else None for r in rows]
        order = sorted((j for j in range(len(rows)) if score[j] is not None), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][1] == l and rows[j][0] != i][:positives]:
            for at, j in enumerate([j for j in order if rows[j][1] != l and low * score[p] <= 100 * score[j] <= high * score[p]][:k]):
                out.append((i, rows[p][0], at + 1, rows[j][0], score[p], score[j]))
    return sorted(out)


def trie(rows):
    """Nodes of the rebuilt conversations of (conv, turn, role, text)."""
    own, members, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    leaves, saved = {}, {}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(words(p[-1][1])) if p else 0)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()]


def quality_features(text):
    """Feature -> value of a text: tokens and pairs, by name."""
    out = collections.Counter()
    seq = []
    for raw in (text or "").split():
        for t in re.findall(r"\w+|[^\w\s]+", raw):
            if len(t) > 1 and t.isupper():
                seq.append("capitals")
            seq.append("=" + t.lower())
    told = ["again" if i and seq[i] == seq[i - 1] else t for i, t in enumerate(seq)]
    out.update((t,) for t in told)
    out.update(zip(told, told[1:]))
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in out.values()))
    return {f: math.log1p(c) / norm for f, c in out.items()}


def ftrl(rows, alpha=0.5, beta=1.0, l1=0.01, l2=0.02, epochs=5):
    """Weights by feature name after follow-the-regularised-leader updates,
    one coordinate at a time; the intercept is the feature None."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, None: 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in list(z)}


def field_likelihood(chains, tags, weight, moves, first):
    """Log-likelihood of a two-tag field, by the sum over all tag sequences."""
    total = 0.0
    for chain, own in zip(chains, tags):
        e = [sum(weight[f] for f in fs) for fs in chain]

        def value(t):
            return first[t[0]] + sum(x for x, on in zip(e, t) if on) + sum(moves[a][b] for a, b in zip(t, t[1:]))
        total += value(own) - math.log(sum(math.exp(value(t)) for t in itertools.product((0, 1), repeat=len(e))))
    return total


def surrogates(entities, draw):
    """(kind, form) -> attempt: rounds in which all but the first holder of a
    surrogate, and all whose surrogate is someone's form, draw again."""
    now = dict.fromkeys(entities, 0)
    while True:
        held = collections.defaultdict(list)
        for (kind, form), attempt in now.items():
            held[kind, draw(kind, form, attempt)].append((attempt, form))
        again = [(kind, form) for (kind, new), own in held.items() for _, form in own
                 if (kind, new) in now or form != min(own)[1]]
        if not again:
            return now
        for e in again:
            now[e] += 1
