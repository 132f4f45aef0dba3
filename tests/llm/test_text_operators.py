"""Jaccard join, line dedup, decontamination, language model, piece table."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from brute import prose
from roomlens.llm import decontaminate, jaccard_join, line_dedup, ngram_lm, piece_table
from roomlens.llm.graph import connected_components
from roomlens.llm.jaccard_join import jaccard_components, one_of_each
from roomlens.llm.registry import model_path, queries


def test_components_of_a_path_a_star_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("hot", [2000, 3])
def test_jaccard_join_equals_brute_force(docs, corpus, hot):
    got = sorted(tuple(r) for r in jaccard_components(docs, hot=hot, fragment_bytes=20_000).collect())
    assert got == brute.jaccard(corpus)


def test_jaccard_join_odd_rows(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 0, None), (None, 3, None), (2, 0, 2), (3, 0, 3), (4, 0, 4),
                          (5, 9, 5)], key=repr)
    assert jaccard_components(odd.limit(0)).count() == 0


def test_one_of_each_keeps_all_columns(odd):
    left = one_of_each(odd, jaccard_components(odd))
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, None, None, 2, 3, 4, 5], key=repr)


def test_line_dedup_equals_brute_force(docs, corpus):
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, wide=False).collect())
    assert got == sorted(brute.deduped(corpus))


def test_simhash_of_long_lines(spark):
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)) for n in (1, 2, 3, 99, 100, 257, 900, 70_000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("words", F.split("line", " "))
    got = {r.line: (r.fp % 2 ** 64, r.n) for r in line_dedup.simhash_lines(df, ["line"], "words").collect()}
    assert got == {x: (brute.simhash(x), len(set(x.split()))) for x in lines}


@pytest.mark.parametrize("crowd", [1, 10_000])
def test_line_groups_do_not_depend_on_the_way(docs, corpus, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, wide=False).collect())
    assert got == sorted(brute.deduped(corpus))


def test_short_lines_meet_by_deletions(spark):
    lines = "the thhe tha cat cot coat dog thnt enou enouw ouin.are ouen.aire organise organize a b ab abc xyzw yzwx".replace(".", "_").split()
    lines = [x.replace("_", " ") for x in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()}
    comp = brute.components(lines, brute.all_alike(lines))
    assert {lines[i] for i, n in got.items() if not n} == {
        min((x for x in lines if comp[x] == c), key=lines.index) for c in set(comp.values())}


def test_line_dedup_finds_all_pairs_of_a_table(spark, sf_small):
    """The registered form against edit similarity alone, over all pairs of
    the lines of the smallest table."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries()["op2_fuzzy_line_dedup"](spark, sf_small).collect()}
    assert got == {d: (t, n) for d, t, n in brute.deduped(texts, brute.all_alike)}


def test_line_dedup_runs_no_python(spark, sf_small):
    import io
    from contextlib import redirect_stdout
    out = io.StringIO()
    with redirect_stdout(out):
        queries()["op2_fuzzy_line_dedup"](spark, sf_small).explain("formatted")
    assert not any(x in out.getvalue() for x in ("Python", "Arrow", "Pandas"))


def test_line_dedup_cuts_texts_once_for_all_keys(spark, corpus):
    """Texts are read for the keys, for the candidates' lines (twice) and for
    the result, not once for each kind of key."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(corpus, 2).map(seen), "doc_id long, text string")
    assert line_dedup.dedup_lines(df).where("n_dropped > 0").count() > 0
    assert read.value <= 4 * len(corpus)


@pytest.mark.parametrize("wide", [False, True])
def test_line_dedup_in_slices(spark, docs, corpus, monkeypatch, tmp_path, wide):
    """Texts, keys and pairs a part at a time give the same rows."""
    docs.repartition(3).write.parquet(f"{tmp_path}/documents")
    df = spark.read.parquet(f"{tmp_path}/documents")
    whole = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, wide=wide).collect())
    for name in ("SLICE_BYTES", "KEY_ROWS", "LINE_ROWS"):
        monkeypatch.setattr(line_dedup, name, 1)
    monkeypatch.setattr(line_dedup, "PAIR_ROWS", 20)
    assert line_dedup._slices(df) == line_dedup.SLICES and line_dedup._slices(docs.limit(0)) >= 1
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(df, wide=wide).collect()) == whole
    assert wide or whole == sorted(brute.deduped(corpus))


def test_pairs_of_unlike_lengths_meet_no_texts(spark, monkeypatch):
    """Lines that share a key but differ too much in length are not among the
    pairs whose lines are read, and nothing written is left behind."""
    import os
    rng = random.Random(12)
    words = [f"{w}word" for w in "abcdefgh"]
    lines = [" ".join(rng.sample(words, 6) + words[:2] * n) for n in range(1, 40, 3) for _ in range(2)]
    rows = [(i, x) for i, x in enumerate(lines)]
    seen = []

    def alike(pairs, occurrences, docs, similarity, own=line_dedup._alike):
        size = dict(docs.join(occurrences, "rk").select("lh", F.length("text")).collect())
        seen.extend((size[r.a], size[r.b]) for r in pairs.collect())
        return own(pairs, occurrences, docs, similarity)

    monkeypatch.setattr(line_dedup, "_alike", alike)
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    comp = brute.components(range(len(lines)), brute.all_alike(lines))
    assert {i for i, n in got.items() if n} <= {i for i, c in comp.items() if c != i}
    assert seen and all(4 * abs(a - b) <= max(a, b) for a, b in seen)
    left = {x for x in set(os.listdir(base)) - before if x.startswith(("lines-", "line-", "short-lines-", "signed-lines-", "candidate-"))}
    assert not left


def test_line_dedup_odd_rows(odd):
    out = line_dedup.dedup_lines(odd, wide=False)
    assert out.columns == odd.columns + ["n_dropped", "all_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_dropped, r.all_dropped) for r in out.collect()), key=repr)
    line = "Some words stand here in a row"
    assert got == sorted([(1, line, 0, False), (1, line, 0, False), (None, None, 0, False), (2, "", 0, False),
                          (None, "Other words stand here in a row", 0, False), (3, None, 0, False), (4, " ", 0, False),
                          (5, "mail me at bob@mail.example.com, you idiot", 1, False)], key=repr)
    # beyond the radius: "other words ..." of the row without an id comes first
    wide = sorted(((r.doc_id, r.text, r.n_dropped, r.all_dropped) for r in line_dedup.dedup_lines(odd).collect()), key=repr)
    assert wide == sorted([(i, "" if i == 1 else t, 1 if i == 1 else n, i == 1) for i, t, n, _ in got], key=repr)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_lines_are_compared_by_characters(spark):
    lines = [" ".join(f"w{i}{'abcdefgh'[i % 8]}" for i in range(20)), "colour of house", "unrelated text here"]
    lines.insert(1, " ".join(f"{w}x" if i % 3 == 0 else w for i, w in enumerate(lines[0].split())))
    rows = list(enumerate(lines + ["color of house"]))
    df = spark.createDataFrame(rows, "rk long, text string").withColumn("lh", F.col("rk"))
    occurrences = df.select("lh", "rk", F.lit(0).alias("pos"))
    pairs = spark.createDataFrame([(0, 1), (2, 4), (3, 4)], "a long, b long")
    got = sorted(tuple(r) for r in line_dedup._alike(pairs, occurrences, df.drop("lh"), 0.75).collect())
    near = [(a, b) for a, b in ((0, 1), (2, 4), (3, 4))
            if 4 * brute.edits(rows[a][1], rows[b][1]) <= max(len(rows[a][1]), len(rows[b][1]))]
    assert got == near == [(0, 1), (2, 4)]


def test_long_lines_are_settled_by_words_only_where_edits_allow(spark):
    """The count of changed words never accepts a pair that characters refuse,
    and accepts some; the verdict on every pair is that of its edits."""
    rng = random.Random(9)
    rows, pairs = [], []
    for share in (0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1):
        a = [f"w{rng.randint(0, 400)}{'abcdefgh'[rng.randint(0, 7)] * rng.randint(1, 5)}" for _ in range(90)]
        b = [x for w in a for x in ([w] if rng.random() >= share else rng.choice(([], [w, "more"], [w[::-1] + "é"])))]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "rk long, text string").withColumn("lh", F.col("rk"))
    occurrences = df.select("lh", "rk", F.lit(0).alias("pos"))
    both = spark.createDataFrame(pairs, "a long, b long")
    text = dict(rows)
    near = [(a, b) for a, b in pairs if 4 * brute.edits(text[a], text[b]) <= max(len(text[a]), len(text[b]))]
    assert sorted(tuple(r) for r in line_dedup._alike(both, occurrences, df.drop("lh"), 0.75).collect()) == near
    lines = spark.createDataFrame([(a, b, text[a], text[b], max(len(text[a]), len(text[b])) // 4) for a, b in pairs],
                                  "a long, b long, x string, y string, allowed int")
    sure = [tuple(r) for r in lines.where(line_dedup._few_words_changed(*map(F.col, ("x", "y", "allowed")))).select("a", "b").collect()]
    assert 3 <= len(sure) and set(sure) <= set(near) and len(near) < len(pairs)


def test_removed_lines_of_a_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    lines = [prose(rng, 12) + f" {i}" for i in range(40)]
    again = [x for line in lines for x in (line, "-", "", f"Only here {rng.random()} {rng.random()} {line[::-1]}")]
    names = "doc_id long, text string, gone_ long, rk_ string, parts_ long, _gone long, __ends long, lh long"
    df = spark.createDataFrame([(1, "\n".join(lines), 5, "r", 6, 7, 8, 9), (2, "\n".join(again), 5, "r", 6, 7, 8, 9),
                                (3, "\n".join(lines), 5, "r", 6, 7, 8, 9)], names)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    want = brute.deduped([(r.doc_id, r.text) for r in df.collect()], brute.all_alike)
    assert {d: (r.text, r.n_dropped) for d, r in got.items()} == {d: (t, n) for d, t, n in want}
    assert all(tuple(r)[2:8] == (5, "r", 6, 7, 8, 9) for r in got.values()) and got[3].all_dropped


def test_wide_search_finds_lines_beyond_the_radius(spark):
    """Against edit similarity alone: nearly all near pairs share a candidate
    key, and no other pair is linked."""
    rng = random.Random(6)
    lines = [prose(rng, rng.randint(6, 24)) for _ in range(60)]
    for n in range(60):
        w = lines[n].split()
        for i in rng.sample(range(len(w)), max(1, len(w) // 6)):
            w[i] = w[i] + "x" if rng.random() < 0.5 else f"new{rng.randint(0, 999)}"
        lines.append(" ".join(w))
    lines += ["The colour of house", "the color of house", "organisation", "organization"]
    rows = [(i, brute.normal_line(x)) for i, x in enumerate(lines)]
    near = {(a, b) for a, s in rows for b, t in rows if a < b
            and 4 * abs(len(s) - len(t)) <= max(len(s), len(t)) and 4 * brute.edits(s, t) <= max(len(s), len(t))}
    assert len(near) >= 60
    within = sum((brute.simhash(rows[a][1]) ^ brute.simhash(rows[b][1])).bit_count() <= 3 for a, b in near)
    assert within < len(near) / 2
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines)], "doc_id long, text string, n int")
    out = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).collect()}
    want = brute.components(range(len(lines)), near)
    dropped = {i for i, n in out.items() if n}
    expected = {i for i, c in want.items() if c != i}
    assert dropped <= expected and len(dropped) >= 0.95 * len(expected)
    assert {61 + 60, 63 + 60} <= dropped


def items(rng, corpus):
    held = {d: t for d, t in corpus}
    verbatim = " ".join(held[305].split()[700:740])
    edited = held[305].split()[1000:1060]
    edited[20] = "changed"
    return [(0, verbatim), (1, " ".join(edited)), (2, prose(rng, 30)), (3, held[20].upper()), (4, ""), (5, None),
            (6, "one two"), (7, verbatim), (8, " ".join(held[305].split()[2000:2055] + ["other"] * 40))]


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_decontamination_equals_brute_force(spark, docs, corpus, block_words):
    listed = items(random.Random(9), corpus)
    got = decontaminate.contamination(docs, spark.createDataFrame(listed, "item_id long, text string"),
                                      block_words=block_words).collect()
    want = brute.contaminated(corpus, listed)
    assert len(got) == len(corpus)
    for r in got:
        assert r.item_ids == sorted(want[r.doc_id]) and r.contaminated == bool(want[r.doc_id])
        if block_words > 1000:
            assert math.isclose(r.max_similarity, max(want[r.doc_id].values(), default=0.0))
    assert [r.item_ids for r in got if r.doc_id == 305] == [[0, 1, 7]]


def test_all_fingerprints_within_the_radius_are_found():
    rng = random.Random(4)
    words = [(i, [b"%d" % rng.randint(0, 99) for _ in range(20)]) for i in range(40)]
    index = decontaminate.ItemIndex(words, 5, 4, 15, {}, 1.0)
    import numpy as np
    for i in range(40):
        flips = rng.sample(range(64), rng.randint(0, 15))
        fp = np.array([int(index.fp[i]) ^ sum(1 << b for b in flips)], np.uint64)
        assert (0, i) in index.lookup(fp, 20)


def test_decontamination_hands_out_few_texts_at_a_time(spark, monkeypatch):
    """Whatever the session's batch size, on the way of marks and of rows."""
    runs, rows, large = (spark.sparkContext.accumulator(0) for _ in range(3))

    def counted(column, real=decontaminate.text_runs):
        runs.add(1)
        rows.add(len(column))
        large.add(int(len(column) > 1000))
        return real(column)

    monkeypatch.setattr(decontaminate, "text_runs", counted)
    bench = spark.createDataFrame([(7, "words stand here in a")], "item_id long, text string")
    df = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("some "), F.when(F.col("id") % 100 == 0, "words stand here in a row").otherwise(F.col("id").cast("string"))).alias("text"))
    marks = decontaminate.contamination(df, bench)
    assert marks.where("contaminated").count() == 40 and marks.count() == 4000
    assert decontaminate.without_contaminated(df, bench).count() == 3960
    assert large.value == 0 and runs.value >= 8 and rows.value == 8000


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(7, "words stand here in a")], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated) for r in decontaminate.contamination(odd, bench).collect()), key=repr)
    assert got == sorted([(1, True), (1, True), (None, False), (None, True), (2, False), (3, False), (4, False), (5, True)], key=repr)
    left = decontaminate.without_contaminated(odd, bench)
    assert left.columns == odd.columns and left.count() == 4
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.limit(0)).collect())
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_language_model_equals_plain_counts(spark, docs, corpus):
    train = [t for d, t in corpus if d % 3]
    model = ngram_lm.fit_lm(docs.where("doc_id % 3 != 0"), shard_bytes=30_000)
    plain = brute.KneserNey(t or "" for t in train)
    texts = dict(corpus)
    small = [d for d, t in corpus if len(t or "") < 400]
    for r in ngram_lm.score_lm(docs.where(F.col("doc_id").isin(small)), model).collect():
        w = brute.words(texts[r.doc_id])
        assert (r.n_tokens, r.train_tokens) == (len(w) + 1, plain.tokens)
        assert r.n_known == sum(x in plain.c1 for x in w) + 1
        assert math.isclose(r.base_score, plain.base(texts[r.doc_id] or ""), rel_tol=1e-9)
        assert math.isclose(r.score, plain.score(texts[r.doc_id] or ""), rel_tol=1e-9)


def test_language_model_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "a b d", "x y a b c c c", "", "b b b a", "300 " * 300]
    model = ngram_lm.fit_lm(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = brute.KneserNey(texts)
    for u in ("a", "zz", "c"):
        assert math.isclose(sum(plain.p(u.encode(), w) for w in [*plain.c1, "unknown"]), 1.0)
    got = ngram_lm.score_lm(spark.createDataFrame([(1, "300 300 300")], "doc_id long, text string"), model).first()
    assert math.isclose(got.score, plain.score("300 300 300"), rel_tol=1e-12)


def test_language_model_odd_rows(spark, odd):
    none = ngram_lm.fit_lm(odd.limit(0))
    got = ngram_lm.score_lm(odd, none).collect()
    assert len(got) == 8 and all(r.n_known == 0 and r.score == r.base_score == 0 for r in got)
    model = ngram_lm.fit_lm(odd)
    got = ngram_lm.score_lm(odd, model).collect()
    assert len(got) == 8 and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    assert ngram_lm.score_lm(odd.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def tables():
    sentencepiece = pytest.importorskip("sentencepiece")
    return piece_table.PieceTable(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_piece_table_equals_the_library(tables, corpus):
    table, library = tables
    rng = random.Random(3)
    letters = list(" abcdeéß▁\n\t漢字☃🎉<s>/.,!0123  \u0000 �") + ["   ", "the ", "ing", "ation", "aaaa", "====", " " * 20]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in texts + [t or "" for _, t in corpus]:
        ids = library.encode(t) + [library.eos_id()]
        joined, n, decoded = table.digest_parts(t)
        assert (joined, n, decoded) == (" ".join(map(str, ids)), len(ids), library.decode(ids))
        assert table.decode(ids) == decoded


def test_piece_decoding_of_any_ids(tables):
    table, library = tables
    rng = random.Random(8)
    for _ in range(2000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(263) for _ in range(rng.randint(0, 12))]
        assert table.decode(ids) == library.decode(ids)


def test_piece_encode_odd_rows(odd, tables):
    got = piece_table.piece_encode(odd, model_path(), with_ids=True, with_text=True).collect()
    assert len(got) == 8
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids[-1] == 2
    assert sorted(r.decoded for r in got if r.n_tokens == 1) == ["", "", ""]
    assert piece_table.piece_encode(odd.limit(0), model_path()).count() == 0


def test_jaccard_arrays_of_a_worker_stay_small():
    """Bytes held at once for a posting that is shipped and for one that is
    gathered, beside the sets and blobs themselves."""
    rng = np.random.default_rng(1)

    def texts(n=300):
        sets = [np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64)) for _ in range(n)]
        return np.arange(n), np.ones(n, np.uint8), rng.integers(0, 1 << 64, n, dtype=np.uint64), np.full(n, 1000, np.int32), sets

    def peak(f):
        tracemalloc.start()
        try:
            f()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    given = texts()
    assert peak(lambda: sum(1 for _ in jaccard_join._ship(*given, 6, 2000))) < 55 * 300_000
    blobs = [b for _ in range(4) for shard, b in jaccard_join._ship(*texts(), 1, 2000) if shard == 1]
    table = pa.table({"shard": pa.array([1] * 4, pa.int32()), "blob": pa.array(blobs, pa.binary())})
    assert peak(lambda: jaccard_join._segments((pa.scalar(1),), table, 1)) < 48 * 600_000
