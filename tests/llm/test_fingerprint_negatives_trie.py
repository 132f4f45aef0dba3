"""Document fingerprints, hard negatives and the prefix trie."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from brute import prose
from roomlens.llm import hard_negatives as hn
from roomlens.llm import multiset_hash as mh
from roomlens.llm import prefix_trie as pt
from roomlens.llm.registry import queries

DOCS = "doc_id long, text string"


# --- fingerprints

def test_fingerprints_of_edits(spark, corpus):
    rows = corpus + [(90, corpus[3][1] + "\n\n" + corpus[4][1]), (100, dict(corpus)[100]), (91, "\n"), (92, "é𝄞ü " * 7)]
    got = mh.edited_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    want = {(d, t): (e, n) for d, t, e, n in brute.edited_texts(rows)}
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)  # 100 is there twice
    texts = {d: t for d, t, *_ in brute.edited_texts(rows)}
    new = spark.createDataFrame([(d, e) for d, _, e, _ in brute.edited_texts(rows)], DOCS)
    anew = {r.doc_id: r.fingerprint for r in mh.fingerprints(new).collect()}
    own = {r.doc_id: r.fingerprint for r in mh.fingerprints(spark.createDataFrame(list(texts.items()), DOCS)).collect()}
    worst = []
    for r in got:
        t = texts[r.doc_id]
        e, after = want[r.doc_id, t]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        # updating the vector gives what hashing the edited text anew gives
        assert r.edited_fingerprint == anew[r.doc_id] and r.fingerprint == own[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        worst += [abs(r.near_edited - brute.pair_likeness(t, e)), abs(r.near_next - brute.pair_likeness(t, after))]
    assert sum(worst) / len(worst) < 0.04 and sorted(worst)[int(0.98 * len(worst))] < 0.2
    same = {}
    for d, t in texts.items():
        same.setdefault(own[d], set()).add("\n".join(sorted(t.split("\n"))))
    assert all(len(s) == 1 for s in same.values())


def test_vectors_add_up(spark):
    rng = random.Random(3)
    parts = [prose(rng, rng.randint(0, 30)) for _ in range(12)] + ["", "a", "a"]
    mixed = parts[:]
    rng.shuffle(mixed)
    df = spark.createDataFrame([("\n".join(parts), "\n".join(mixed), "\n".join(parts[:5]), "\n".join(parts[5:]))], "w string, m string, a string, b string")
    for c in df.columns:
        df = mh.with_vector(df, c, f"v{c}")
    r = df.select(*[mh.fingerprint_text(x).alias(n) for n, x in (
        ("w", F.col("vw")), ("m", F.col("vm")), ("sum", mh.plus(F.col("va"), F.col("vb"))),
        ("less", mh.minus(F.col("vw"), F.col("va"))), ("b", F.col("vb")), ("a", F.col("va")))],
        mh.likeness(F.col("vw"), F.col("vm")).alias("same")).first()
    assert r.w == r.m == r.sum and r.less == r.b and r.a != r.b and r.same == 1.0


def test_lanes_wrap_and_long_texts(spark):
    """Lanes are held modulo their power; one text of a megabyte."""
    v = spark.range(1).select(F.struct(F.array(F.lit((1 << 31) - 1).cast("long")).alias("lanes"), F.array(F.lit((1 << 23) - 1)).alias("places")).alias("v"))
    r = v.select(mh.plus(F.col("v"), F.col("v")).alias("s")).first().s
    assert r.lanes == [-2] and r.places == [-2]
    long = ("word " * 9 + "x\n") * 20000
    got = mh.edited_fingerprints(spark.createDataFrame([(1, long), (2, "a b"), (3, "y" * 10**6)], DOCS)).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_chars == len(long) and abs(by[1].near_edited - 0.8) < 0.01 and by[3].n_chars == 10**6


def test_fingerprints_odd_rows(spark, odd):
    got = mh.edited_fingerprints(odd).collect()
    assert len(got) == 8 and sum(r.doc_id is None for r in got) == 2
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and by[2][0].fingerprint == by[3][0].fingerprint and by[2][0].n_chars == 0
    assert mh.edited_fingerprints(odd.limit(0)).count() == 0 and mh.fingerprints(odd).count() == 8
    one = mh.edited_fingerprints(odd.where("doc_id = 4")).first()  # its own next
    assert one.near_next == 1.0


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(mh, "COPIES", 10)
    rows = [(1, "one two three")] * 35 + [(2, "four five")] * 10 + [(3, "six")]
    got = mh.edited_fingerprints(spark.createDataFrame(rows, DOCS)).groupBy("doc_id", "edited_sha256").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in got) == [(1, 35), (2, 10), (3, 1)]


def test_fingerprints_run_no_python(spark, sf_small):
    plan = queries()["op11_document_fingerprints"](spark, sf_small)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- hard negatives

def _mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect())


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 2000)  # many cells
    monkeypatch.setattr(hn, "MATRIX", 500)
    rng = random.Random(11)
    axes = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(0, 700):
        a = rng.choice(axes)
        rows.append((i * 5, [round(x + rng.gauss(0, 0.7), 1) for x in a], rng.randint(0, 3) if i % 3 else 0))
    rows += [(5 * i + 1, rows[7][1], i % 4) for i in range(60)]  # ties
    assert _mined(spark, rows) == brute.negatives(rows)
    few = rows[:90]
    assert _mined(spark, few, positives=2, k=3, low=0, high=70) == brute.negatives(few, 2, 3, 0, 70)


def test_hard_negatives_registered(spark, sf_small):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    got = queries()["op12_hard_negatives"](spark, sf_small)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == brute.negatives(rows)


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (2, [0.4, 0.4], 2), (3, None, 2), (4, [1.0, None], 2),
            (5, [1.0, math.nan], 2), (6, [math.inf, 1.0], 2), (7, [0.6, 0.6], None), (None, [0.6, 0.6], 2), (8, [0.6], 2), (9, [], 2), (100, [], 3),
            (200, [0.5, 0.1], 9), (300, [-1.0, 0.0], 4), (301, [0.5, 0.0], 4), (302, [-0.2, 0.0], 5)]
    got = _mined(spark, rows)
    # the repeated row counts once, 2's other vector is a row of its own
    assert got == [(0, 1, 1, 2, 131072, 65536), (0, 1, 2, 2, 131072, 52224)]
    for big in (2.0 ** 22, 2.0 ** 40):  # sums beyond a double's whole numbers; beyond a long
        huge = [(0, [big, big], 1), (1, [big, 1.0], 1), (2, [big / 2, 0.0], 2)]
        n = int(256 * big)
        assert _mined(spark, huge) == ([(0, 1, 1, 2, n * n + 256 * n, n * n // 2)] if big < 2.0 ** 30 else [])
    assert _mined(spark, []) == []
    clash = spark.createDataFrame([(r[0], r[1], r[2], 7, "x") for r in rows[:3]], "vec_id long, embedding array<float>, label int, id int, rk string")
    assert hn.hard_negatives(clash, F.col("vec_id") % 100 == 0).count() == 1
    with pytest.raises(ValueError):
        hn.hard_negatives(clash, F.lit(True), low=95)


# --- prefix trie

def _trie(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return sorted((tuple(r) for r in pt.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_prefix_trie_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 60), 80, 81, 99, 140]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "so it is", "no", "yes  of course\n"]) if t else "hello there"))
    rows += [(200, t, "user", f"turn {t} of a long one") for t in range(60)] + [(201, 0, "user", "x")]
    rows += [(60, None, None, None), (60, None, "user", "early"), (60, 3, "user", "late"), (61, 1, None, "a b"), (61, 1, None, "a b"), (62, 0, "user", "")]
    rng.shuffle(rows)
    assert _trie(spark, rows) == sorted(brute.trie(rows), key=repr)


def test_prefix_trie_registered(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op13_prefix_trie"](spark, sf_small)
    assert dict(got.dtypes) == {**{c: "bigint" for c in got.columns}, "ends_sha256": "string"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute.trie(rows), key=repr)


def test_prefix_trie_odd_rows(spark):
    rows = [(None, 0, "user", "nobody", 1, "x"), (5, None, None, None, None, None), (5, None, None, None, None, None), (45, 0, "user", "a", 3, "y")]
    schema = "conv_id long, turn long, role string, text string, depth int, k1 string"
    got = _trie(spark, rows, schema)
    assert got == sorted(brute.trie([r[:4] for r in rows]), key=repr)
    assert _trie(spark, [], schema) == [] and _trie(spark, rows[:1], schema) == []


def test_prefix_trie_takes_no_rounds(spark):
    """As many jobs for long chains with branches as for a few turns."""
    def jobs(rows, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert _trie(spark, rows) == sorted(brute.trie(rows), key=repr)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    flat = [(20 * c, t, "user", f"turn {t}") for c in range(3) for t in range(2)]
    deep = [(20 * c, t, "user", f"turn {t} {t // (30 * c + 30)}") for c in range(5) for t in range(140)]
    assert jobs(deep, "deep trie") <= jobs(flat, "flat trie") + 10


def test_path_totals(spark):
    """Weights of any sign; members that know no node of their own."""
    paths = {1: "abcd", 2: "abx", 3: "abcd", 4: "q", 5: "abxyz", 6: "ab"}
    known = {}
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            known.setdefault(p[:d], c)
    weight = {p: (7 * i) % 11 - 4 for i, p in enumerate(known)}
    total = {p: sum(w for q, w in weight.items() if q.startswith(p)) for p in known}
    number = {p: i for i, p in enumerate(known)}
    nodes = spark.createDataFrame([(number[p], 0, c, len(p), weight[p]) for p, c in known.items()], "k1 long, k2 long, conv long, depth long, w long")
    members = spark.createDataFrame([(number[p[:d]], 0, c) for c, p in paths.items() for d in range(len(p) + 1)], "k1 long, k2 long, conv long")
    got = pt.path_totals(nodes, members, ["w"])
    assert got.columns == nodes.columns
    assert {r.k1: r.w for r in got.collect()} == {number[p]: t for p, t in total.items()}


def test_ends_of_a_node_in_runs(spark, monkeypatch):
    ids = [(1, 2, i) for i in range(25000, 0, -1)] + [(1, 3, 7), (0, 0, 1)]
    got = {(r.k1, r.k2): r.ends for r in pt.end_digests(spark.createDataFrame(ids, "k1 long, k2 long, conv long")).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, range(1, 25001))).encode()).hexdigest(),
                   (1, 3): hashlib.sha256(b"7").hexdigest(), (0, 0): hashlib.sha256(b"1").hexdigest()}


def test_subtree_totals(spark):
    """A chain with twigs and a random tree; depths may skip."""
    rng = random.Random(4)
    parent, depth = {0: None}, {0: 0}
    for v in range(1, 90):
        p = v - 1 if v < 50 else rng.randrange(v)
        parent[v], depth[v] = p, depth[p] + rng.choice([1, 1, 3])
    weight = {v: rng.randint(-3, 9) for v in parent}
    total = dict(weight)
    for v in sorted(parent, key=lambda v: -depth[v]):
        if v:
            total[parent[v]] += total[v]
    tree = spark.createDataFrame([(v, depth[v], p, None if p is None else depth[p], weight[v]) for v, p in parent.items()],
                                 "c long, d long, pc long, pd long, w long")
    got = pt.subtree_totals(tree, ["w"]).collect()
    assert len(got) == 90 and {r.c: r.w for r in got} == total


def test_running_sums_over_partitions(spark):
    rows = [(g, i, (g * 7 + i) % 5) for g, n in ((1, 3000), (2, 1), (3, 40)) for i in range(n)]
    got = {(r.g, r.i): r.x for r in pt.running_sums(spark.createDataFrame(rows, "g long, i long, x long"), "g", "i", ["x"]).collect()}
    total = {}
    for g, i, x in rows:
        total[g, i] = total.get((g, i - 1), 0) + x
    assert got == total
