"""Conversation prefix trie by prefix keys and sums over members.

1. Turns get their place in the conversation and, after the rebuild, running
   sums of place-salted hashes: the sums up to turn d are the key of the first
   d turns.  Both come from range-partitioned tables, so a conversation of
   any length is spread over tasks.
2. Nodes are the distinct keys.  A node is known by its smallest member and
   its depth.
3. Subtree totals take no rounds.  The nodes known by one conversation are
   the last ones of its path, so every node of a subtree is known by a member
   of the subtree's top.  A node's total is the sum over its own
   conversation's nodes from there on (running sums from the end) and, for
   each other member, over all nodes known by that member, which all lie
   below: one equi-join on the conversation and one aggregate on the key.
4. The members that end at a node are joined to text in runs by
   range-partitioned tasks and digested run by run in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomlens.operators.indexing import index_within_groups
from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import ensure_checkpoint_dir, package_on_workers, scratch_path

WORDS = r"[^\x20\x09-\x0D]+"
RUN_IDS = 50_000  # ids joined to one text
_LANES = ("l0", "l1", "l2", "l3")  # of 32 bits each
_LOW = 0xFFFFFFFF


def _halves(a: Column, b: Column) -> list[Column]:
    return [x.alias(n) for n, x in zip(_LANES, (a.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(a, 32),
                                                b.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(b, 32)))]


def running_sums(df: DataFrame, group: str, order: str, cols: list[str]) -> DataFrame:
    """``df`` with each of ``cols`` replaced by its sum over the rows of the
    group up to and including this one.

    Rows are range-partitioned on (group, order) and checkpointed; windows run
    inside (partition, group) only, and the sums of a group's earlier
    partitions, one row for each, are added."""
    ranged = df.repartitionByRange(group, order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("_pid", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_pid", group).agg(*[F.sum(c).alias(c) for c in cols])
    sums = sums.select("_pid", group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in cols])
    local = ranged.select("_pid", *df.columns, *[F.sum(c).over(here).alias(f"_here_{c}") for c in cols])
    return local.join(sums, ["_pid", group]).select(*[
        (F.col(f"_here_{c}") + F.col(f"_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the rebuilt conversations, conversations) of turns with
    (conv, ord, h1, h2, words): (conv, depth, h1, h2, words) and
    (conv, length)."""
    placed = index_within_groups(turns, ["conv"], "ord", "pos").drop("ord").checkpoint()
    size = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = size.select("conv", "size", h.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    bases = size.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_size", F.lit(0)))).checkpoint()
    head = placed.where("conv % 20 = 0 and pos < 3").select(F.col("conv").alias("base"), "pos", "h1", "h2", "words")
    taken = convs.where("m > 0").join(head, "base").where("pos < m") \
        .select("conv", (F.col("pos") + 1).alias("depth"), "h1", "h2", "words")
    # (conv, m, h) of conversations, to a conversation's own turns: small
    # beside the turns, and a long conversation's turns are split by AQE
    own = placed.join(broadcast_if_small(convs.select("conv", "h", "m")), "conv").where("pos >= h") \
        .select("conv", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "h1", "h2", "words")
    return taken.union(own), convs.select("conv", (F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k1, k2, conv) to (k1, k2, first, ids): runs of at most
    RUN_IDS ids of one node, joined by commas."""
    for b in batches:
        k1, k2, conv = (b[c].to_numpy() for c in ("k1", "k2", "conv"))
        n = len(conv)
        if not n:
            continue
        new = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        starts = np.concatenate([np.arange(s, e, RUN_IDS) for s, e in zip(new, [*new[1:], n])])
        names = list(map(str, conv.tolist()))
        yield pa.RecordBatch.from_pydict({
            "k1": k1[starts], "k2": k2[starts], "first": conv[starts],
            "ids": pa.array([",".join(names[s:e]) for s, e in zip(starts, [*starts[1:], n])], pa.string())})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k1, k2, first, ids) to (k1, k2, ends): one digest a node,
    fed run by run."""
    key, state = None, None
    for b in batches:
        out = []
        for *k, ids in zip(b["k1"].to_pylist(), b["k2"].to_pylist(), b["ids"].to_pylist()):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                         ["k1", "k2", "ends"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])],
                                         ["k1", "k2", "ends"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends) of (k1, k2, conv): SHA-256 of each node's members'
    ids, ascending, joined by commas.  A node's ids are sorted and joined by
    many tasks; the digest alone, which has to read them in order, is one
    task's, and holds one run at a time."""
    runs = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv") \
        .mapInArrow(_joined_ids, "k1 long, k2 long, first long, ids string")
    return runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends string")


def path_totals(nodes: DataFrame, members: DataFrame, weights: list[str]) -> DataFrame:
    """``nodes`` with each of ``weights`` summed over the node's subtree, its
    top included.  ``nodes`` has one row per key (k1, k2) with its smallest
    member ``conv`` and its ``depth``; ``members``, (k1, k2, conv), one row per
    node and member."""
    whole = [f"_all_{w}" for w in weights]
    per = nodes.groupBy("conv").agg(*[F.sum(w).alias(a) for w, a in zip(weights, whole)])
    others = members.join(broadcast_if_small(per), "conv").groupBy("k1", "k2").agg(
        *[(F.sum(a) - F.min_by(a, "conv")).alias(a) for a in whole])
    below = running_sums(nodes.withColumn("_up", -F.col("depth")), "conv", "_up", weights)
    return below.join(others, ["k1", "k2"]).select(*[
        (F.col(c) + F.col(f"_all_{c}")).alias(c) if c in weights else F.col(c) for c in nodes.columns])


def subtree_totals(tree: DataFrame, weights: list[str]) -> DataFrame:
    """(c, d, weights): sums over the subtree, its top included, of a tree of
    (c, d, pc, pd, weights) with nodes (c, d), d growing downwards by any
    amount, and parents (pc, pd), null for the root.  Rows whose parent is no
    node are not reached and give no row.

    For trees without member paths, by contraction: every round first rakes
    the leaves (each adds what it has gathered to its parent and is done),
    then compresses unary chains: nodes with one child, chosen by a bit of
    their depth so that no two chosen ones are neighbours, hand what they
    have to the edge above their child, which moves up.  The tree shrinks to
    the root.  Then the rounds are undone, the last one first: a node taken
    out of a chain has its child's total plus what it handed over.  All joins
    are on unique nodes, so no parent's children ever meet in one task."""
    spark = tree.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "trie-totals")
    here, up = ["c", "d"], ["pc", "pd"]
    edge = [f"e_{w}" for w in weights]

    def kids(t: DataFrame) -> DataFrame:
        return t.where("pd is not null").groupBy(*up).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c", "d")).alias("only")) \
            .select(F.col("pc").alias("c"), F.col("pd").alias("d"), "n", "only")

    now = tree.select(*here, *up, *weights, *[F.lit(0).cast("long").alias(e) for e in edge]).join(kids(tree), here, "left") \
        .withColumn("leaf", F.col("n").isNull()).drop("n", "only")
    raked, spliced = [], []
    bits = max(1, int(tree.agg(F.max("d")).first()[0] or 0).bit_length())
    while True:
        rnd = len(raked)
        leaves = now.where("leaf")
        raked.append(leaves.select(*here, *weights))
        gathered = leaves.where("pd is not null").groupBy(*up).agg(*[F.sum(F.col(w) + F.col(e)).alias(f"g_{w}") for w, e in zip(weights, edge)]) \
            .withColumnsRenamed({"pc": "c", "pd": "d"})
        inner = now.where("not leaf").join(gathered, here, "left").select(*here, *up, *[
            (F.col(w) + F.coalesce(f"g_{w}", F.lit(0))).alias(w) for w in weights], *edge)
        inner = inner.join(kids(inner), here, "left").checkpoint()
        if inner.isEmpty():
            break
        bit = F.lit(1 << rnd % bits).cast("long")
        out = (F.coalesce(F.col("n") == 1, F.lit(False)) & F.col("pd").isNotNull() & (F.col("d").bitwiseAND(bit) == 0)
               & (F.col("only.d").bitwiseAND(bit) != 0))
        gone = inner.where(out).select(F.col("only.c").alias("c"), F.col("only.d").alias("d"), *[
            F.col(x).alias(f"v_{x}") for x in (*here, *up, *weights, *edge)])
        now = inner.where(~out).join(gone, here, "left").withColumn("leaf", F.col("n").isNull())
        spliced.append(now.where("v_d is not null").select(
            *here, *[F.col(f"v_{x}") for x in here], *[(F.col(e) + F.col(f"v_{w}")).alias(f"o_{w}") for w, e in zip(weights, edge)]))
        now = now.select(*here, *[F.when(F.col("v_d").isNotNull(), F.col(f"v_{p}")).otherwise(F.col(p)).alias(p) for p in up], *weights, *[
            (F.col(e) + F.coalesce(F.col(f"v_{w}") + F.col(f"v_{e}"), F.lit(0))).alias(e) for w, e in zip(weights, edge)], "leaf")
    # the last round first: a spliced node's child was raked or spliced later
    for rnd in reversed(range(len(raked))):
        raked[rnd].write.parquet(f"{path}/{rnd}/raked")
        if rnd:
            later = spark.read.schema(raked[0].schema).parquet(*[f"{path}/{r}/{kind}" for r in range(rnd, len(raked)) for kind in
                                                              (("raked", "spliced") if r + 1 < len(raked) else ("raked",))])
            spliced[rnd - 1].join(later, here).select(F.col("v_c").alias("c"), F.col("v_d").alias("d"), *[
                (F.col(w) + F.col(f"o_{w}")).alias(w) for w in weights]).write.parquet(f"{path}/{rnd - 1}/spliced")
    return spark.read.schema(raked[0].schema).parquet(*[f"{path}/{r}/{kind}" for r in range(len(raked)) for kind in
                                                      (("raked", "spliced") if r + 1 < len(raked) else ("raked",))])


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Turns stand in the order of their number, null first; turns of one number
    by role, then by a hash of their text, and repeated rows one after the
    other.  Null roles and texts are empty.  A conversation c starts with the
    first h turns of c - c % 20 (h = crc32 of c in decimal, modulo 4) and goes
    on with its own turns after its first h.  Rows without a conversation id
    are no conversation.  An empty table has no node, not even the root.

    A sequence's key is the sum of 128-bit hashes of its turns with their
    places.  Other columns are not read."""
    spark = conversations.sparkSession
    package_on_workers(spark)
    ensure_checkpoint_dir(spark)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    turns = turns.select("conv", F.struct("turn", "role", "h1", "h2").alias("ord"), "h1", "h2", "words")
    rows, convs = rebuilt_turns(turns)
    salted = rows.select("conv", "depth", "words", *_halves(F.xxhash64("depth", "h1", "h2"), F.xxhash64("h2", "depth", "h1")))
    salted = salted.withColumns({f"own_{c}": F.col(c) for c in _LANES})

    def key(prefix: str, cols: list[Column]) -> list[Column]:
        a, b, c, d = (x.bitwiseAND(F.lit(_LOW)) for x in cols)
        return [F.shiftleft(a, 32).bitwiseOR(b).alias(f"{prefix}1"), F.shiftleft(c, 32).bitwiseOR(d).alias(f"{prefix}2")]

    keyed = running_sums(salted, "conv", "depth", list(_LANES)).select(
        "conv", "depth", "words", *key("k", [F.col(c) for c in _LANES]), *key("p", [F.col(c) - F.col(f"own_{c}") for c in _LANES]))
    path = scratch_path(spark, "trie-turns")
    keyed.write.parquet(path)
    keyed = spark.read.parquet(path)
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0") \
        .select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("depth"),
                "conv", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    nodes = keyed.groupBy("k1", "k2", "depth").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = root.unionByName(nodes).checkpoint()
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    children = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")) \
        .withColumnsRenamed({"p1": "k1", "p2": "k2"})
    last = keyed.join(broadcast_if_small(convs.withColumnRenamed("length", "depth")), ["conv", "depth"], "left_semi").select("k1", "k2", "conv") \
        .union(convs.where("length = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv"))
    full = nodes.join(parents, ["p1", "p2"], "left").join(children, ["k1", "k2"], "left").join(end_digests(last), ["k1", "k2"], "left") \
        .select("k1", "k2", "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends"),
                F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).checkpoint()
    members = keyed.select("k1", "k2", "conv").union(convs.select(F.lit(0).cast("long"), F.lit(0).cast("long"), "conv"))
    return path_totals(full, members, ["n_leaves", "saved"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
