"""Document fingerprints: a homomorphic multiset hash of paragraphs, with
DataFrame functions only.

A paragraph is a line of the text.  Each has a wide vector:

* 32 lanes modulo 2**32, hashed from its SHA-256.  They tell texts apart: two
  texts have equal sums if (and, but for a chance of about 2**-1024, only if)
  they hold the same paragraphs equally often, in whatever order.  The
  lanes are no defence against somebody who searches for collisions.
* 256 lanes modulo 2**24 in which every word of the paragraph, with the word
  that follows it, adds 1 or -1 at one place.  Sums of these are a sketch
  whose inner products estimate those of the counts of word pairs, so two
  fingerprints show how alike their texts are, to about 0.06.

A text's vector is the sum of its paragraphs' vectors, so vectors of inserted
paragraphs are added to it (``plus``), those of deleted ones subtracted
(``minus``), and the untouched rest is never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomlens.operators.indexing import index_within_groups
from roomlens.operators.sizing import broadcast_if_small
from roomlens.session import ensure_checkpoint_dir

LANES, LANE_BITS = 32, 32
PLACES, PLACE_BITS = 256, 24
SPACE = r"[\x20\x09-\x0D]+"
# Copies of one row that a task writes before they are dealt out.
COPIES = 4096
BROADCAST_BYTES = 32 << 20


def _wrapped(x: Column, bits: int) -> Column:
    """x modulo 2**bits, in the range around zero."""
    half = 1 << (bits - 1)
    return F.pmod(x + F.lit(half), F.lit(1 << bits)) - F.lit(half)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for all its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _combined(a: Column, b: Column, sign: int) -> Column:
    def lanes(name: str, bits: int) -> Column:
        return F.zip_with(a[name], b[name], lambda x, y: _wrapped(x + y * F.lit(sign), bits)).alias(name)
    return F.struct(lanes("lanes", LANE_BITS), lanes("places", PLACE_BITS))


def plus(a: Column, b: Column) -> Column:
    """Vector of a text after the paragraphs of ``b`` are inserted."""
    return _combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """Vector of a text after the paragraphs of ``b`` are deleted."""
    return _combined(a, b, -1)


def fingerprint_text(v: Column) -> Column:
    """A vector as a base64 string; equal strings, equal vectors."""
    def digits(name: str, bits: int) -> Column:
        return F.array_join(F.transform(v[name], lambda x: F.lpad(
            F.hex(F.pmod(x.cast("long"), F.lit(1 << bits))), bits // 4, "0")), "")
    return F.translate(F.base64(F.unhex(F.concat(digits("lanes", LANE_BITS), digits("places", PLACE_BITS)))), "\r\n", "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the inner product by the sum of the squares, on the word-pair
    lanes, kept within 0 and 1: 1 for equal vectors, about 0.5 for two
    texts of one size that share half of their word pairs, about 0 for
    strangers.  Two vectors without any word are alike (1) if equal, else 0."""
    def inner(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x["places"], y["places"], lambda s, t: s.cast("long") * t),
                           F.lit(0).cast("long"), lambda s, t: s + t)
    squares = inner(a, a) + inner(b, b)
    return F.when(squares == 0, (a["lanes"] == b["lanes"]).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * inner(a, b) / squares)))


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the vector of the text column; a null text counts as empty
    (one empty paragraph).

    The places are counted by sorting: every word pair becomes its place and
    sign as one small number, 2 * PLACES marks are added between them, and the
    marks' positions in the sorted array differ by the counts.  Work and
    memory of a row follow its text's length."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def pairs(words: Column) -> Column:
        # place * 4 + 1 for a minus, + 3 for a plus
        return F.transform(words, lambda w, i: (
            F.xxhash64(w, F.get(words, i + 1)).bitwiseAND(F.lit(PLACES * 2 - 1)) * 2 + 1).cast("int"))
    df = df.withColumn("mh_lines", lines)
    df = df.withColumn("mh_sorted", F.sort_array(F.concat(
        F.flatten(F.transform("mh_lines", lambda p: _let(
            F.filter(F.split(p, SPACE), lambda w: w != ""), pairs))),
        F.sequence(F.lit(2), F.lit(4 * PLACES), F.lit(2)))))
    # a second use of the sorted array keeps the sort out of the lambda, in compiled code
    df = df.withColumn("mh_marks", F.when(F.size("mh_sorted") > 0, F.filter(F.transform(
        "mh_sorted", lambda x, i: F.when(x.bitwiseAND(F.lit(1)) == 0, i).otherwise(-1)), lambda x: x >= 0)))
    marks = F.col("mh_marks")
    places = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda j: _wrapped(
        F.get(marks, j * 2 + 1) - F.get(marks, j * 2) * 2 + F.coalesce(F.get(marks, j * 2 - 1), F.lit(-1)), PLACE_BITS))
    sums = _let(F.transform("mh_lines", lambda p: F.sha2(p, 256)), lambda digests: F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: _wrapped(F.aggregate(
            digests, F.lit(0).cast("long"),
            lambda s, p: s + F.xxhash64(i, p).bitwiseAND(F.lit((1 << LANE_BITS) - 1))), LANE_BITS)))
    return df.withColumn(out, F.struct(sums.alias("lanes"), places.alias("places"))) \
        .drop("mh_lines", "mh_sorted", "mh_marks")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2, n): null texts empty, 128-bit key of id and text,
    code points."""
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(key.alias("id"), text.alias("text"), F.xxhash64(key, text).alias("k1"),
                       F.xxhash64(F.lit(1), text, key.cast("string")).alias("k2"), F.length(text).cast("long").alias("n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, vector, fingerprint) of every row, in one pass without a
    shuffle.  Null and empty texts have the vector of one empty paragraph;
    rows without an id and repeated rows each give a row."""
    own = _named(docs, id_col, text_col).select("id", "text", "n")
    return with_vector(own, "text", "vector").select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "vector", fingerprint_text(F.col("vector")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs``.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document by id; after
    the last document comes the first.  Its vector is not hashed anew: the
    paragraphs that the edit touches are taken off the text's vector and
    those that replace them are added.

    Null texts are empty.  Rows without an id come first; rows of one id
    follow each other by a hash of their text.  Rows that repeat id and text
    are one document: each gets the same result, from the next other row.
    Other columns are not read.  An empty table gives no rows.

    Rows are numbered from their keys alone.  Then one shuffle by number
    brings each document's kept half and the head of its next together, with
    their vectors; copies of a row are merged before it."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    own = _named(docs, id_col, text_col)
    ids = own.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    ids = index_within_groups(ids.withColumn("ord", F.struct("id", "k1", "k2")).drop("id"), [], "ord", "row").drop("ord").checkpoint()
    total, copies = ids.agg(F.count(F.lit(1)), F.max("copies")).first()
    after = ids.select(F.pmod(F.col("row") + 1, F.lit(max(total, 1))).alias("row"), (F.col("n") / 2).cast("long").alias("take"))
    order = broadcast_if_small(ids.join(after, "row").select("k1", "k2", "row", "take"), BROADCAST_BYTES)
    # kept: what stays of the text; cut: where its last, split paragraph begins
    rows = own.join(order, ["k1", "k2"]) \
        .withColumn("kept", F.left("text", F.col("n") - (F.col("n") / 2).cast("long"))) \
        .withColumn("cut", F.length("kept") - F.length(F.substring_index("kept", "\n", -1))) \
        .withColumn("first", F.when(F.col("cut") > 0, F.left("text", F.col("cut") - 1))) \
        .withColumn("rest", F.expr("substring(text, cut + 1)"))
    rows = with_vector(with_vector(rows, "first", "v_first"), "rest", "v_rest") \
        .withColumn("v", F.when(F.col("first").isNull(), F.col("v_rest")).otherwise(plus(F.col("v_first"), F.col("v_rest"))))
    mine = F.struct("id", "n", "kept", "cut", "v", "v_rest")
    follows = F.struct(F.left("text", "take").alias("head"), "v")
    sides = rows.select(F.explode(F.array(
        F.struct(F.col("row").alias("at"), mine.alias("mine"), F.lit(None).cast(rows.select(follows.alias("x")).schema["x"].dataType).alias("follows")),
        F.struct(F.pmod(F.col("row") - 1, F.lit(max(total, 1))).alias("at"),
                 F.lit(None).cast(rows.select(mine.alias("x")).schema["x"].dataType).alias("mine"), follows.alias("follows")))).alias("s")).select("s.*")
    met = sides.groupBy("at").agg(F.max("mine").alias("m"), F.max("follows").alias("f"), F.count("mine").alias("c")) \
        .select("m.*", F.col("f.head").alias("head"), F.col("f.v").alias("v_next"), "c") \
        .withColumn("rest", F.concat(F.expr("substring(kept, cut + 1)"), F.col("head")))
    met = with_vector(met, "rest", "v_new").withColumn("v_edited", plus(minus(F.col("v"), F.col("v_rest")), F.col("v_new")))
    out = met.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"),
                     F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"),
                     fingerprint_text(F.col("v")).alias("fingerprint"), fingerprint_text(F.col("v_edited")).alias("edited_fingerprint"),
                     likeness(F.col("v"), F.col("v_edited")).alias("near_edited"), likeness(F.col("v"), F.col("v_next")).alias("near_next"), "c")
    if (copies or 0) > COPIES:  # a row with very many copies is written by many tasks
        out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPIES)))) \
            .repartition("part", id_col).withColumn("c", F.least(F.lit(COPIES).cast("long"), F.col("c") - F.col("part") * COPIES)).drop("part")
    return out.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))).drop("c")
