"""Toxicity, sharding, quality, vectors, personal data, pipeline, queries."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from brute import prose
from roomlens.llm import pii, quality, sharding, toxicity, vector_join

BAD = ["idiot", "vekulo", "vekuta", "vekumi"]


def labelled(spark, n=600, seed=1):
    """Texts whose toxic ones hold a bad word or a bad stem, whose poor ones
    are all capitals or one word again and again."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, rng.randint(20, 80)).split(" ")
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "!"]))
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), int(good)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {x[0]: x[1:] for x in labels})


def test_marginals_equal_enumeration():
    import itertools
    rng = np.random.default_rng(0)
    crf = toxicity.Field(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    lens = np.array([3, 1, 5, 2])
    e = rng.normal(size=lens.sum())
    got, moves, first, log_z = toxicity.marginals(e, lens, crf, expect=True)
    at, want, want_moves, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in lens:
        total, on = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            s = crf.first[tags[0]] + sum(e[at + i] for i in range(n) if tags[i]) + \
                sum(crf.moves[a, b] for a, b in zip(tags, tags[1:]))
            p = np.exp(s)
            total += p
            on += p * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += p
        want += (on / total).tolist()
        want_moves += pairs / total
        want_z += np.log(total)
        at += n
    assert np.allclose(got, want) and np.allclose(moves, want_moves) and np.isclose(first.sum(), 4)
    assert np.isclose(log_z, want_z)


def test_toxicity_on_unseen_rows(spark):
    docs, labels, truth = labelled(spark)
    crf = toxicity.fit_toxicity(docs, labels.where("doc_id < 400"))
    got = toxicity.score_toxicity(docs.where("doc_id >= 400"), crf).collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in got]) > 0.95
    text = dict(docs.collect())
    for r in got:
        for s in r.spans:
            assert all(any(x in w for x in BAD) for w in text[r.doc_id][s.start:s.stop].split())
    assert sum(len(r.spans) for r in got) >= 30


def test_toxicity_odd_rows(spark, odd):
    docs, labels, _ = labelled(spark, 200)
    crf = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(odd, crf).collect()
    assert [r.doc_id for r in got if r.predicted] == [5] and all(0 <= r.score <= 1 for r in got)
    assert toxicity.without_toxic(odd, crf).columns == odd.columns
    assert toxicity.without_toxic(odd, crf).count() == 7
    assert toxicity.score_toxicity(odd.limit(0), crf).count() == 0
    none = toxicity.fit_toxicity(docs.limit(0), labels)
    assert not any(r.predicted for r in toxicity.score_toxicity(odd, none).collect())


def test_quality_on_unseen_rows(spark, odd):
    docs, labels, truth = labelled(spark)
    model = quality.fit_quality(docs, labels.where("doc_id < 400"))
    got = quality.score_quality(docs.where("doc_id >= 400"), model).collect()
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in got]) > 0.97
    assert len(quality.score_quality(odd, model).collect()) == 8
    assert quality.score_quality(odd.limit(0), model).count() == 0
    w, bias = quality.fit_quality(docs.limit(0), labels)
    assert not w.any() and bias == 0


def test_quality_features_do_not_depend_on_neighbours():
    texts = ["One TWO two, two!", "", "a a a", "end"]
    together = quality.features(texts, quality.Tokens())
    for i, t in enumerate(texts):
        own = quality.features([t], quality.Tokens())
        assert (together[1][together[0] == i] == own[1]).all() and np.allclose(together[2][together[0] == i], own[2])


def test_shard_table_equals_turns_in_full():
    names, size = [f"s{i}" for i in range(7)], 101
    import xxhash
    order = {s: [(xxhash.xxh64_intdigest(s, seed=1) + k * (xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1)) % size
                 for k in range(size)] for s in names}
    table = [None] * size
    while None in table:
        for i, s in enumerate(names):
            slot = next((x for x in order[s] if table[x] is None), None)
            if slot is not None:
                table[slot] = i
    assert sharding.fill_table(names, size) == table
    counts = np.bincount(sharding.fill_table(names, 65_537))
    assert counts.max() - counts.min() <= 1
    heavy = np.bincount(sharding.fill_table(names, 65_537, {"s0": 2}))
    assert abs(heavy[0] - 2 * heavy[1]) <= 2
    for wrong in ((["a", "a"], 101), ([], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.fill_table(*wrong)


def test_few_rows_move_when_a_shard_leaves(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    names = [f"s{i}" for i in range(10)]
    a = {r.doc_id: r.shard for r in sharding.place(docs, names, text_col=None).collect()}
    b = {r.doc_id: r.shard for r in sharding.place(docs, names[:-1], text_col=None).collect()}
    moved = [d for d in a if a[d] != b[d] and a[d] != "s9"]
    assert len(moved) < 0.1 * len(a) and len(a) == 4000


def test_placement_odd_rows(odd):
    got = sharding.place(odd, ["x", "y", "z"]).collect()
    assert len(got) == 8 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.place(odd.limit(0), ["x"]).count() == 0


def test_vector_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "HOT", 64)
    monkeypatch.setattr(vector_join, "TILE", 32)
    rng = np.random.default_rng(3)
    c = rng.standard_normal((5, 24))
    rows = [(i, (c[i % 5] + 0.12 * rng.standard_normal(24)).tolist()) for i in range(300)]
    rows += [(2000 + i, rows[7][1]) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [None] + [1.0] * 23), (3004, [float("nan")] * 24),
             (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [-1.0, -2.0]), (3008, [5.0]), (3009, [1e-300] * 24),
             (3010, [1e300] * 24), (3011, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vector_join.near_links(df).collect()) == brute.near_vectors(rows)
    assert vector_join.near_links(df.limit(0)).count() == 0


def test_entities_and_their_surrogates():
    text = ("Mail Bob.K+x@Mail3.example.com or BOB.K+X@mail3.example.com, +1 (988) 555-2485 / +1 988 555 2485 at "
            "42.144.35.254, card 4111 1111 1111 1111 or 4111-1111-1111-1111. Mrs Smith met Anna SMITH. Анна Иванова.")
    found = pii.detect(text)
    assert [k for _, _, k, _ in found] == ["email", "email", "phone", "phone", "ip", "card", "card", "surname", "given_f",
                                           "surname", "given_f", "surname"]
    new = [pii.render(k, text[a:b], pii.surrogate(k, f, 0, b"key")) for a, b, k, f in found]
    assert new[0].lower() == new[1].lower() and new[2][:3] == "+1 " and re.sub(r"\D", "", new[2]) == re.sub(r"\D", "", new[3])
    assert all(0 <= int(x) <= 255 for x in new[4].split(".")) and new[5].replace(" ", "-") == new[6]
    digits = re.sub(r"\D", "", new[5])
    assert pii._luhn(digits[:-1]) == int(digits[-1])
    assert new[7].lower() == new[9].lower() and new[9].isupper() and re.fullmatch("[А-Яа-я]+", new[11])
    assert all(n.lower() not in text.lower() for n in new)


def test_colliding_surrogates_are_told_apart(spark):
    rows = [("ssn", f"{i:03d}456789"[:9]) for i in range(40)] + [("ip", f"{a}.{b}.{c}.{d}") for a in range(1, 10) for b in range(1, 10)
                                                                  for c in (1, 2) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "kind string, form string")
    got = pii.assign_surrogates(df, b"k").collect()
    assert len(got) == len(rows) and len({(r.kind, r.new) for r in got}) == len(rows)
    assert not {(r.kind, r.new) for r in got} & set(rows)
    assert max(r.attempt for r in got) > 0


def test_key_of_surrogates_on_a_cluster():
    """A cluster whose session sets no key runs with a secret of its own."""
    from types import SimpleNamespace

    from roomlens.llm.registry import PII_KEY, pii_key

    def session(master, app, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, other: conf.get(k, other)),
                               sparkContext=SimpleNamespace(master=master, applicationId=app))
    with pytest.warns(UserWarning, match=PII_KEY):
        one = pii_key(session("spark://host:7077", "app-1"))
    with pytest.warns(UserWarning):
        other = pii_key(session("yarn", "app-2"))
    assert one == pii_key(session("spark://host:7077", "app-1")) != other and len(one) == len(other) == 64
    assert pii_key(session("spark://host:7077", "app-1", **{PII_KEY: "own"})) == "own"
    assert pii_key(session("local[2]", "app-3")) == "for tests only"


def test_replacement_odd_rows(odd):
    out = {(r.doc_id, r.n_entities, r.text) for r in pii.replace_pii(odd, "key").collect()}
    assert len(out) == 7 and (None, 0, None) in out and (2, 0, "") in out
    mail = next(t for d, n, t in out if d == 5)
    assert "bob@" not in mail and mail.endswith("idiot\nSome words stand here in a row")
    assert pii.replace_pii(odd.limit(0), "key").count() == 0


@pytest.fixture(scope="module")
def small_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").cache()
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def _ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_pipeline_toxicity(spark, sf_small, small_texts):
    import corpus_pipeline as p
    from roomlens.llm.registry import queries
    assert _ids(p.toxicity(spark, small_texts[0], sf_small)) == {
        r.doc_id for r in queries()["op1_toxicity_crf"](spark, sf_small).collect() if not r.predicted}


def test_pipeline_line_dedup(spark, sf_small, small_texts):
    import corpus_pipeline as p
    docs, texts = small_texts
    lines = p.line_dedup(spark, docs, sf_small)
    assert lines.columns == docs.columns
    assert {r.doc_id: r.text for r in lines.collect()} == {
        d: t for d, t, _ in brute.deduped(texts, brute.all_alike) if any(brute.normal_line(x) for x in t.split("\n"))}


def test_pipeline_jaccard_join(spark, sf_small, small_texts):
    import corpus_pipeline as p
    docs, texts = small_texts
    assert _ids(p.jaccard_join(spark, docs, sf_small)) == {d for d, _, c in brute.jaccard(texts) if d == c}


def test_pipeline_decontamination(spark, sf_small, small_texts):
    import corpus_pipeline as p
    docs, texts = small_texts
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    assert _ids(p.decontamination(spark, docs, sf_small)) == {d for d, m in brute.contaminated(texts, bench).items() if not m}


def test_pipeline_runs(spark, sf_small, small_texts):
    import corpus_pipeline as p
    assert 0 < p.run(spark, sf_small).count() <= len(small_texts[1])


def test_queries_return_a_row_per_document(spark, sf_small):
    from roomlens.llm import registry
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    for name, q in registry.queries().items():
        if name.split("_")[0] not in ("op6", "op12", "op13"):
            out = q(spark, sf_small)
            assert "doc_id" in out.columns and out.count() == n, name


def test_other_mentions_of_a_name_get_its_surrogate():
    text = "Smith, they say. Mr John Smith came. SMITH left, john stayed; Smithson and smith's dog too. smith@x.org"
    found = pii.detect(text)
    assert [text[a:b] for a, b, k, _ in found if k == "surname"] == ["Smith", "Smith", "SMITH", "smith"]
    assert [text[a:b] for a, b, k, _ in found if k == "given_m"] == ["John", "john"]
    assert {f for _, _, k, f in found if k == "surname"} == {"smith"}
    assert [text[a:b] for a, b, k, _ in found if k == "email"] == ["smith@x.org"]
    assert pii.detect("Smith left.") == []


def test_detection_of_many_entities_is_not_quadratic():
    text = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(40_000))
    start = time.process_time()
    assert len(pii.detect(text)) == 40_000
    assert time.process_time() - start < 10


def test_a_full_format_is_widened(spark, monkeypatch):
    full = [("email", f"{a}@{b}.com") for a in "abcdef" for b in "abcdef"] + [("password", "!!!!!!")]
    monkeypatch.setattr(pii, "TRIES", 1)
    monkeypatch.setattr(pii, "MOST", 8)
    got = pii.assign_surrogates(spark.createDataFrame(full, "kind string, form string"), b"k").collect()
    assert sorted((r.kind, r.form) for r in got) == sorted(full)
    new = {(r.kind, r.new) for r in got}
    assert len(new) == len(full) and not new & set(full)


@pytest.mark.parametrize("kind, form", [
    ("email", "a@b.com"), ("ip", "1.2.3.4"), ("card", "4111111111111111"), ("ssn", "123456789"), ("phone", "4915112345"),
    ("iban", "DE12345678901234"), ("cloud_key", "AKIA" + "A" * 16), ("password", "!!!!!!"), ("token", "a1" * 8), ("surname", "smith")])
def test_every_kind_widens_after_a_few_tries(kind, form):
    wide = {pii.surrogate(kind, form, n, b"k") for n in range(pii.TRIES, pii.TRIES + 20)}
    assert len(wide) == 20 and form not in wide
    if kind != "ip":
        assert max(map(len, wide)) > len(form)
    if kind == "card":
        assert all(pii._luhn(x[:-1]) == int(x[-1]) for x in wide)
    assert all(pii.render(kind, form, x).lower() == x.lower() for x in wide)


def test_quality_equals_plain_updates(spark, odd):
    """Features, training order, weights and scores of the operator against
    plain loops; rows are trained on in the order of their id's hash."""
    docs, labels, truth = labelled(spark, 40)
    # Few rows and 24 bits: features that share a place would move scores by 5e-5.
    got = quality.score_quality(docs.unionByName(odd.select("doc_id", "text")), quality.fit_quality(docs, labels, bits=24),
                                bits=24).collect()
    text = dict(docs.collect())
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    w = brute.ftrl([(brute.quality_features(text[i]), truth[i][1]) for i in order])

    def score(t):
        return 1 / (1 + np.exp(-w[None] - sum(w.get(f, 0.0) * v for f, v in brute.quality_features(t).items())))
    want = [(i, score(t)) for i, t in text.items()] + [(r.doc_id, score(r.text)) for r in odd.collect()]
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1])) for x in (got, want))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1] for r in got], [r[1] for r in want], atol=1e-5)
    assert len(set(np.round([r[1] for r in got], 3))) > 20


def test_equal_rows_with_unlike_labels_train_in_a_fixed_order(spark):
    """Ties: one id with both labels, and equal texts of several ids."""
    docs = spark.createDataFrame([(1, "good text"), (2, "good text"), (2, "good text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, None), (None, 1)], "doc_id long, quality int")
    one, two = (quality.fit_quality(docs.repartition(n), labels) for n in (1, 3))
    assert (one[0] == two[0]).all() and one[1] == two[1] and one[1] != 0
    own, other = (toxicity.fit_toxicity(docs.repartition(n), labels.withColumnRenamed("quality", "toxic")) for n in (1, 3))
    assert (own.weight == other.weight).all() and np.allclose(own.text, other.text)


def test_field_training_follows_the_likelihood():
    """The first training step moves each weight by its gradient's sign, as
    finite differences of the likelihood by enumeration give it, and more
    steps raise the likelihood."""
    texts = [("the idiot was here\nidiot", 1), ("a river stone", 0), ("light idiot house now", 1), ("the house", 0)]
    marked = set(toxicity.token_features("idiot"))
    lists, tags = [], []
    for t, y in texts:
        for chain in toxicity.chains(t):
            fs = [toxicity.token_features(raw) for raw in chain]
            tag = [int(raw == "idiot") for raw in chain]
            if any(tag) or not y:
                lists.append(fs)
                tags.append(tag)
    assert sum(map(sum, tags)) == 3 and len(lists) == 5

    def value(crf):
        penalty = 0.05 * sum(float((x ** 2).sum()) for x in (crf.weight, crf.moves, crf.first))
        return brute.field_likelihood(lists, tags, crf.weight, crf.moves, crf.first) - penalty

    def zero():
        return toxicity.Field(np.zeros(1 << toxicity.BITS), np.zeros((2, 2)), np.zeros(2))
    step = toxicity.fit_field(texts, marked, rounds=1, rate=1.0)
    for name in ("weight", "moves", "first"):
        at = np.argwhere(getattr(step, name)) if name == "weight" else np.argwhere(np.ones_like(getattr(step, name)))
        for i in map(tuple, at):
            up, down = zero(), zero()
            getattr(up, name)[i] += 1e-5
            getattr(down, name)[i] -= 1e-5
            g = (value(up) - value(down)) / 2e-5
            assert np.isclose(getattr(step, name)[i], g / np.sqrt(g * g + 1e-6), atol=1e-4)
    used = {f for fs in lists for x in fs for f in x}
    assert set(np.flatnonzero(step.weight).tolist()) <= used
    values = [value(toxicity.fit_field(texts, marked, rounds=n)) for n in (0, 1, 10, 100)]
    assert values == sorted(values) and values[-1] > values[0] + 1


def test_marking_features_by_plain_counts(spark):
    docs, labels, truth = labelled(spark, 300)
    rows = docs.join(labels, "doc_id").select(F.col("text").alias("text_"), F.col("toxic").alias("y"))
    got = toxicity.marking_features(rows.repartition(5))
    seen = [[{f for raw in t.split() for f in toxicity.token_features(raw)} for i, t in docs.collect() if truth[i][0] == y]
            for y in (0, 1)]
    want = set()
    for f in set().union(*seen[1]):
        c, t = (sum(f in s for s in x) for x in seen)
        n = [len(x) for x in seen]
        rate = (c + t) / sum(n)
        g = t * np.log(t / (n[1] * rate)) + (c * np.log(c / (n[0] * rate)) if c else 0)
        if t > 2 and g > 12 and t * n[0] > 10 * c * n[1]:
            want.add(f)
    assert got == want and want >= set(toxicity.token_features("idiot")[:1])


def test_surrogates_equal_plain_rounds(spark):
    """Attempts by brute force, and every text as its plain replacement."""
    rng = random.Random(8)
    people = [f"Mr {a} {b}" for a in ("John", "Paul") for b in ("Smith", "Brown", "Stone", "Miller", "King", "Baker")]
    pool = people + [f"{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 3)}.{rng.randint(1, 3)}" for _ in range(150)] + \
        [f"{a}{b}@{c}.com" for a in "abc" for b in "abc" for c in "abcdef"]
    rows = [(i, " and ".join(rng.sample(pool, 6))) for i in range(200)] + [(900, None), (901, ""), (902, rows_of_one(pool))]
    secret = hashlib.sha256(b"key").digest()
    entities = {(k, f) for _, t in rows for _, _, k, f in pii.detect(t or "")}
    attempts = brute.surrogates(entities, lambda k, f, n: pii.surrogate(k, f, n, secret))
    assert max(attempts.values()) > 0

    def plain(text):
        at, out = 0, ""
        for a, b, k, f in pii.detect(text):
            out += text[at:a] + pii.render(k, text[a:b], pii.surrogate(k, f, attempts[k, f], secret))
            at = b
        return out + text[at:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(df.repartition(4), "key").collect()}
    assert got == {i: None if t is None else plain(t) for i, t in rows}


def rows_of_one(pool):
    return "\n".join(pool * 3)
