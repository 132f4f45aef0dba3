"""Graph patterns (K-1..K-9) and fact retrieval (K-7) on the seed graph."""

import pytest
from pyspark.sql import functions as F

from roomlens.operators import kg


@pytest.fixture(scope="module")
def seed(spark):
    return kg.seed_triples(spark)


def test_displays_bgp(seed):
    got = sorted((r.dlabel, r.llabel) for r in kg.displays(seed).collect())
    assert got == [("Hallway Display", "hallway"), ("Kitchen Display", "kitchen"), ("Office Display", "office")]


def test_policies_one_row_per_location(seed):
    assert sorted(r.llabel for r in kg.policies(seed).collect()) == ["hallway", "kitchen", "office"]


def test_metrics_optional_bounds(seed):
    got = {r.mlab: (r.min, r.max) for r in kg.metrics_with_ranges(seed).collect()}
    assert got["temperature"] == ("20", "26") and got["pressure"] == (None, None)
    assert len(got) == 5


def test_labels_limited_is_ordered(seed):
    n_labels = seed.where(F.col("p") == kg.RDFS_LABEL).count()
    out = [tuple(r) for r in kg.labels_limited(seed, 20).collect()]
    assert len(out) == min(n_labels, 20) and out == sorted(out)
    five = [tuple(r) for r in kg.labels_limited(seed, 5).collect()]
    assert five == out[:5]


def test_disconnected_pattern_rejected(seed):
    with pytest.raises(ValueError):
        kg.bgp(seed, [("?a", "rdf:type", "ex:Metric"), ("?b", "rdf:type", "ex:Policy")])


def test_nodes_edges_tracks(seed):
    nodes = {r.id.rsplit("/", 1)[-1]: (r.label, r.kind) for r in kg.nodes(seed).collect()}
    assert nodes["Kitchen"] == ("kitchen", "location") and nodes["PolicyVentilate"][1] == "policy"
    assert len(nodes) == 3 + 3 + 1 + 5
    assert kg.edges(seed).count() == 6
    tr = kg.tracks(seed).collect()
    assert len(tr) == 3 * 4      # every location x the four tracked metric labels present


def _brute_context(triples, text, limit=6):
    """K-7 written directly from its definition, one text at a time."""
    words = [w.lower() for w in text.split() if len(w) >= 3]
    t = [tuple(r) for r in triples]
    labels = sorted((s, o) for s, p, o, _ in t if p == kg.RDFS_LABEL)
    types = {(s, o) for s, p, o, _ in t if p == kg.RDF_TYPE}
    lo = {s: o for s, p, o, _ in t if p == kg.EX + "recommendedMin"}
    hi = {s: o for s, p, o, _ in t if p == kg.EX + "recommendedMax"}
    lines = []
    for s, label in labels:
        if not any(w in label.lower() for w in words):
            continue
        if len(lines) >= limit:
            break
        name = s.rsplit("/", 1)[-1]
        lines.append(f"{name} --label--> {label}")
        if (s, kg.EX + "Metric") in types and (s in lo or s in hi):
            lines.append(f"{name} --recommendedRange--> {lo.get(s, '-inf')} to {hi.get(s, 'inf')}")
    for s, label in labels:
        if (s, kg.EX + "Policy") not in types or not any(w in label.lower() for w in words):
            continue
        lines.append(f"Policy: {label}")
        if len(lines) >= limit:
            break
    return "\n".join(lines)


TEXTS = [
    "Is the kitchen temperature ok?",
    "humidity and pressure in the office and hallway, also the display",
    "tem hum",                                   # substrings of labels match
    "no match xx",
    "Ventilate now: temperature too high in KITCHEN, office, hallway, humidity, pressure, gas, iaq",
]


def test_fact_context_matches_brute_force(spark, seed):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.context) for r in kg.fact_context(seed, texts, limit=6).collect()}
    rows = seed.collect()
    for i, text in enumerate(TEXTS):
        exp = _brute_context(rows, text)
        assert got[i][1] == exp, (text, got[i][1], exp)
        assert got[i][0] == (len(exp.split("\n")) if exp else 0)
    # trap 12: at most limit + 1 label lines plus one policy line
    assert max(n for n, _ in got.values()) <= 8


def test_fact_context_of_long_labels(spark):
    """Only the places of a label where a word may stand are cut."""
    triples = [(kg.EX + f"d{i}", kg.RDFS_LABEL, f"Dataset#{'0' * 300}{i:03d} Zone zone", "string") for i in range(40)]
    triples += [(kg.EX + "p", kg.RDF_TYPE, kg.EX + "Policy", "iri"), (kg.EX + "p", kg.RDFS_LABEL, "Check data", "string")]
    t = spark.createDataFrame(triples, kg.TRIPLE_SCHEMA)
    texts = ["the data here", "dataset# zone", "nothing 0000017 at all", "ta", "check the ZON", "0000039 0000038"]
    got = {r.doc_id: r.context for r in kg.fact_context(t, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [_brute_context(t.collect(), x) for x in texts]
    seg = spark.createDataFrame([("dataset#" + "0" * 300,)], "low string")
    words = spark.createDataFrame([("data",), ("dataset",), ("x" * 200,), ("set",), ("#00",)], "word string")
    assert sorted(r.word for r in kg._words_within(seg, words).collect()) == ["#00", "data", "dataset", "set"]


def test_patterns_linked_later_and_repeated_variables(spark):
    rows = [("a", "rdf:p", "a"), ("a", "rdf:p", "b"), ("b", "rdf:q", "c")]
    t = spark.createDataFrame([(kg.expand(s), kg.expand(p), kg.expand(o), "iri") for s, p, o in rows], kg.TRIPLE_SCHEMA)
    assert kg.bgp(t, [("?x", "rdf:p", "?x")]).count() == 1
    assert kg.bgp(t, [("?x", "rdf:p", kg.expand("b")), (kg.expand("b"), "rdf:q", "?z"), ("?x", "?any", "?y"),
                      ("?y", "rdf:q", "?z")]).count() == 1
    with pytest.raises(ValueError):
        kg.bgp(t, [("?x", "rdf:p", "?y")], optional=[("?u", "rdf:q", "?v")])
