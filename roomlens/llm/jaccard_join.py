"""N-gram Jaccard self-join by vertical partitioning.

The global n-gram order (here the order of 64-bit shingle hashes, with the
exact document frequency in front of it where a prefix is taken) is cut into
fragments.  Each task ships, per fragment, one packed blob of its postings;
one task per fragment then finds the shingles held by two or more different
sets, so a set arrives as *segments*, one per fragment.  Overlaps are counted
segment by segment and summed per pair.

What bounds the work:

* equal sets are one class from the start (set fingerprint and size), so a
  group of exact copies never meets itself;
* a shingle held by one class cannot add to an overlap and is dropped at its
  fragment; a class whose shared shingles number less than the least overlap
  it needs (``ceil(t * size)``) has no partner and is dropped whole;
* candidates share a shingle of their prefixes in ascending document
  frequency, so common passages rarely make candidates;
* candidates come in two rounds.  First each class meets one pivot per prefix
  shingle (a star, not all pairs).  Verified links are merged into
  components; afterwards only pairs from *different* components that share a
  prefix shingle are left, and those are tested all.  Every link between
  different components is therefore found, and the components are exact.

A very frequent shingle is split: its postings go to extra shards dealt by
(shingle, class), and its fragment only hears that it is frequent.  A task
splits a shingle that one of its runs holds in more than ``hot`` texts, in an
eighth of the run's texts, or so often that at this rate over all rows it
would fill a quarter of a fragment (from ``LEAST_HOT`` texts on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomlens.llm.common import (WordHasher, deltas, mix64, pack, shingle_hashes, text_runs, total_bytes, unpack,
                                 words_of)
from roomlens.llm.graph import connected_components
from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import scratch_path, session_conf

# Postings a task gathers before it ships them.  (A worker's arrays grow with
# it; two workers have to fit beside an executor's heap.)
FLUSH = 400_000
# Characters of text that are cut into words at a time.
RUN_CHARS = 500_000
# Rows of an Arrow batch: the executor and its worker each hold whole batches.
BATCH_ROWS = 1000
# A shingle in no more texts of a run than this is never split.
LEAST_HOT = 32
# Frequency noted for split shingles, which no task counts whole.
SPLIT_DF = 1 << 30
# Pairs are verified in so many fragments of the order (as a power of two).
CUT_BITS = 3
# Text bytes per fragment (about 2 million postings).
FRAGMENT_BYTES = 14_000_000
SEGMENTS = pa.schema([("frag", pa.int32()), ("fp", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()),
                      ("hs", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32()))])


def _ship(ids, valid, fps, ns, sets, bits, hot) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) rows of one flush.  Shards 0..2^bits-1 are fragments,
    2^bits..2^(bits+1)-1 take the split hot postings, -1 and below carry the
    texts' own rows."""
    yield -1 - int(mix64(ids[:1].astype(np.uint64))[0] % np.uint64(1 << bits)), pack(ids, valid, fps, ns)
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sets.clear()
    if not len(h):
        return
    doc = np.repeat(np.arange(len(ns), dtype=np.uint32), ns)
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(first, len(h)))
    busy = size > min(hot, max(LEAST_HOT, min(len(ns) // 8, FLUSH >> (bits + 2))))
    split = np.repeat(busy, size)
    named = h[first[busy]]
    shard = (h >> np.uint64(64 - bits)).astype(np.int32)
    if split.any():
        shard[split] = (mix64(h[split] ^ mix64(fps[doc[split]])) >> np.uint64(64 - bits)) + np.uint64(1 << bits)
        order = np.argsort(shard, kind="stable")
        h, doc, shard = h[order], doc[order], shard[order]
    for a, b in _spans(shard):
        used, local = np.unique(doc[a:b], return_inverse=True)
        s = int(shard[a])
        marks = named[(named >> np.uint64(64 - bits)).astype(np.int64) == s]
        yield s, pack(deltas(h[a:b]), local.astype(np.uint32), fps[used], ns[used], marks)
    for s in set((named >> np.uint64(64 - bits)).astype(np.int64).tolist()) - set(np.unique(shard).tolist()):
        marks = named[(named >> np.uint64(64 - bits)).astype(np.int64) == s]
        none = np.zeros(0, np.uint64)
        yield s, pack(none, none.astype(np.uint32), none, none.astype(np.int32), marks)


def _spans(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return list(zip(np.concatenate(([0], cut)).tolist(), np.append(cut, len(sorted_keys)).tolist()))


def _postings(batches, k: int, bits: int, hot: int):
    hasher = WordHasher()
    held: list = [[], [], [], [], []]
    count = 0

    def flush():
        ids, valid, fps, ns, sets = held
        for shard, blob in _ship(np.array(ids, np.int64), np.array(valid, np.uint8), np.array(fps, np.uint64),
                                 np.array(ns, np.int32), sets, bits, hot):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())],
                                             names=["shard", "blob"])
        for part in held:
            part.clear()

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for start, texts in text_runs(batch.column(1), RUN_CHARS):
            h, lens = hasher.flat([words_of(t) for t in texts])
            s, doc = shingle_hashes(h, lens, k)
            ends = np.searchsorted(doc, np.arange(len(lens) + 1))
            for i, doc_id in enumerate(ids[start: start + len(texts)]):
                u = np.unique(s[ends[i]: ends[i + 1]])
                held[0].append(doc_id or 0)
                held[1].append(doc_id is not None)
                held[2].append(int(mix64(u + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)))
                held[3].append(len(u))
                if len(u):
                    held[4].append(u)
                count += len(u)
            if count >= FLUSH:
                yield from flush()
                count = 0
    if held[0]:
        yield from flush()


def _segments(key, table: pa.Table, bits: int) -> pa.Table:
    shard = key[0].as_py()
    blobs = (unpack(b.as_py()) for b in table.column("blob"))
    if shard < 0:
        ids, valid, fps, ns = (np.concatenate(x) for x in zip(*blobs))
        size = len(ids)
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(size + 1, np.int32)), pa.array([], pa.int64()))
        return pa.Table.from_arrays(
            [pa.array(np.full(size, -1, np.int32)), pa.array(fps.view(np.int64)), pa.array(ns),
             pa.array(ids, mask=valid == 0), empty,
             pa.ListArray.from_arrays(pa.array(np.zeros(size + 1, np.int32)), pa.array([], pa.int32()))],
            schema=SEGMENTS)
    # A posting is its shingle and its text's place among the blobs' texts;
    # what belongs to the text is looked up for those that stay.
    h, text, fp, n, marks, texts = [], [], [], [], [], 0
    for d, local, fps, ns, mark in blobs:
        h.append(np.cumsum(d, dtype=np.uint64))
        text.append(local + np.uint32(texts))
        fp.append(fps)
        n.append(ns)
        marks.append(mark)
        texts += len(fps)
    h = np.concatenate(h)
    text, fp, n, marks = np.concatenate(text), np.concatenate(fp), np.concatenate(n), np.concatenate(marks)
    order = np.argsort(h)
    h, text = h[order], text[order]
    del order
    always = shard >= 1 << bits
    if not always:  # split postings of frequent shingles all stay
        same = h[1:] == h[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else np.zeros(0, bool)
        if len(marks):
            several |= np.isin(h, marks)
        h, text = h[several], text[several]
    fp, n = fp[text], n[text]
    del text
    order = np.lexsort((n, fp, h))
    h, fp, n = h[order], fp[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1]) | (n[1:] != n[:-1])
    h, fp, n = h[new], fp[new], n[new]
    _, at, df = np.unique(h, return_inverse=True, return_counts=True)
    df = df[at]
    split = np.full(len(h), always) | (np.isin(h, marks) if len(marks) else False)
    df = np.where(split, SPLIT_DF, df)
    stay = df > 1
    h, fp, n, df = h[stay], fp[stay], n[stay], df[stay]
    order = np.lexsort((h, n, fp))
    h, fp, n, df = h[order], fp[order], n[order], df[order]
    starts = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (n[1:] != n[:-1])))) if len(h) else np.zeros(0, int)
    offsets = pa.array(np.append(starts, len(h)).astype(np.int32))
    return pa.Table.from_arrays(
        [pa.array(np.full(len(starts), shard, np.int32)), pa.array(fp[starts].view(np.int64)), pa.array(n[starts]),
         pa.nulls(len(starts), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))),
         pa.ListArray.from_arrays(offsets, pa.array(df.astype(np.int32)))], schema=SEGMENTS)


def _verified(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose similarity reaches the threshold: partial overlaps
    per fragment, summed per pair.  ``segs``: cid, n, frag, hs."""
    left = segs.select(F.col("cid").alias("a"), "frag", F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = segs.select(F.col("cid").alias("b"), "frag", F.col("n").alias("nb"), F.col("hs").alias("hb"))
    part = pairs.join(left, "a").join(right, ["b", "frag"]) \
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("part"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")) \
        .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       percent: int = 75, fragment_bytes: int = FRAGMENT_BYTES, hot: int = 2000) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two rows link when ``100 * |A and B| >= percent * |A or B|`` over their
    sets of distinct k-word shingles; ``component_id`` is the smallest id
    reachable by links.  Ids are integers.

    Null text counts as empty; an empty set links with nothing, so such a
    row is its own component.  Repeated ids give one row each.  A row whose
    id is null keeps its row and takes part through its text, and its
    component is null only if no row of its component has an id.  Other
    columns are ignored.  Shingles are compared by 64-bit hashes and equal
    sets by (64-bit set fingerprint, size)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = total_bytes(docs, "text")
    bits = max(6, int(np.ceil(np.log2(max(1, size / fragment_bytes)))))
    shipped = docs.mapInArrow(lambda it: _postings(it, k, bits, hot), "shard int, blob binary")
    table = scratch_path(spark, "segments")
    with session_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        shipped.groupBy("shard").applyInArrow(
            lambda key, t: _segments(key, t, bits),
            "frag int, fp long, n int, doc_id long, hs array<long>, dfs array<int>").write.parquet(table)
    found = spark.read.parquet(table)
    rows = found.where("frag < 0").select("fp", "n", "doc_id")
    # A class without any id gets a negative key of its own.
    classes = rows.where("n > 0").groupBy("fp", "n").agg(
        F.coalesce(F.min("doc_id"), -1 - F.abs(F.max("fp") % (1 << 62))).alias("cid"))
    need = F.ceil(F.col("n") * percent / 100)
    parts = found.where("frag >= 0").select("frag", "fp", "n", "hs", "dfs")
    able = parts.groupBy("fp", "n").agg(F.sum(F.size("hs")).alias("shared")).where(F.col("shared") >= need)
    # Shared shingles of each class in ascending frequency.  (One may come
    # from its fragment and from a split, so their number is taken anew.)
    by = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("dfs", "hs"))))["hs"]
    ordered = scratch_path(spark, "ordered")
    parts.join(able.join(classes, ["fp", "n"]).select("fp", "n", "cid"), ["fp", "n"]).groupBy("cid", "n") \
        .agg(F.array_distinct(by).alias("by")).where(F.size("by") >= need).write.parquet(ordered)
    ordered = spark.read.parquet(ordered)
    segments = scratch_path(spark, "fragments")

    def fragment(f: int):
        return F.filter("by", lambda h: F.shiftrightunsigned(h, 64 - CUT_BITS) == f)
    ordered.select("cid", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("frag"), fragment(f).alias("hs"))
                                                   for f in range(1 << CUT_BITS)])).alias("x")) \
        .select("cid", "n", "x.*").where(F.size("hs") > 0).write.parquet(segments)
    segs = spark.read.parquet(segments)
    # The shingles of one holder alone come first in the order and match
    # nothing; of the shared ones so many are left in the prefix.
    prefixes = ordered.select("cid", "n", F.size("by").alias("shared"),
                              F.slice("by", F.lit(1), (F.size("by") - need + 1).cast("int")).alias("p"))
    heads = prefixes.select("cid", "n", "shared", F.posexplode("p").alias("i", "h")) \
        .select("cid", "n", "shared", "h", (F.col("n") - F.col("shared") + F.col("i") + 1).alias("at"))

    def may_link(n1, at1, n2, at2):
        """With its first common shingle at these places of the order, a pair
        can still reach the overlap that the threshold asks for."""
        rest = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2)) + 1
        return (100 + percent) * rest >= percent * (F.col(n1) + F.col(n2))

    # The pivot of a shingle is the holder with the smallest part of shingles
    # of its own: of a group of edited copies, the one nearest to the original.
    mark = F.struct(((F.col("n") - F.col("shared")) / F.col("n")).alias("r"), F.xxhash64("cid").alias("x"), "cid", "n", "at")
    pivot = heads.groupBy("h").agg(F.min(mark).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1") \
        .select("h", F.col("p.cid").alias("pc"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"))
    star = heads.join(pivot, "h").where((F.col("cid") != F.col("pc")) & may_link("n", "at", "pn", "pat")) \
        .select(F.least("cid", "pc").alias("a"), F.greatest("cid", "pc").alias("b")).distinct().checkpoint()
    links = _verified(star, segs, percent).checkpoint()
    first = connected_components(links, "a", "b")
    named = heads.join(first.withColumnRenamed("node", "cid"), "cid", "left") \
        .withColumn("comp", F.coalesce("component", "cid")).drop("component")
    # Shingles whose holders are in several components; all pairs between a
    # smaller component and the others.  A pair that passes at a later common
    # shingle has passed at its first one, where more is left to share.
    per = named.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k")) \
        .where("k > 1").select("h", F.col("top.comp").alias("main"))
    open_ = named.join(main, "h")
    minor = open_.where("comp != main").select(
        "h", F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("comp").alias("comp2"))
    across = minor.join(open_, "h").where(
        (F.col("comp") != F.col("comp2")) & may_link("n", "at", "n2", "at2")
        & ((F.col("comp") == F.col("main")) | (F.col("cid") < F.col("c2")))) \
        .select(F.least("cid", "c2").alias("a"), F.greatest("cid", "c2").alias("b")).distinct() \
        .join(star, ["a", "b"], "left_anti")
    rest = _verified(across, segs, percent)
    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest)
    merged = connected_components(joined, "a", "b").withColumnRenamed("node", "cid")
    label = classes.join(merged, "cid", "left").select("fp", "n", F.coalesce("component", "cid").alias("comp"))
    low = label.join(classes, ["fp", "n"]).groupBy("comp").agg(
        F.min(F.when(F.col("cid") >= 0, F.col("cid"))).alias("low"))
    final = label.join(low, "comp").select("fp", "n", F.col("low").alias("component_id"))
    return rows.join(final, ["fp", "n"], "left").select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that carry their component's id:
    one of each group of near copies.  Of rows that share an id one stays;
    rows without an id stay.  The ids to drop are broadcast only up to a
    measured size."""
    own = F.col(f"`{id_col}`")
    gone = components.where(own != F.col("component_id")).select(id_col).distinct()
    left = docs.join(broadcast_if_small(gone, 32 << 20), id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    twice = broadcast_if_small(components.where(own.isNotNull()).groupBy(id_col).count().where("count > 1")
                               .select(id_col), 32 << 20)
    repeated = left.join(twice, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(twice, id_col, "left_anti").union(repeated.select(*[f"`{c}`" for c in docs.columns]))
