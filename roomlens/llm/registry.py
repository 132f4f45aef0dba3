"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import secrets
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlens.llm.decontaminate import contamination
from roomlens.llm.hard_negatives import hard_negatives
from roomlens.llm.jaccard_join import jaccard_components
from roomlens.llm.line_dedup import dedup_lines
from roomlens.llm.multiset_hash import edited_fingerprints
from roomlens.llm.ngram_lm import fit_lm, held_out, score_lm
from roomlens.llm.pii import replace_pii
from roomlens.llm.piece_table import piece_encode
from roomlens.llm.prefix_trie import prefix_trie
from roomlens.llm.quality import fit_quality, score_quality
from roomlens.llm.sharding import place
from roomlens.llm.toxicity import fit_toxicity, score_toxicity
from roomlens.llm.vector_join import near_links
from roomlens.sources.tables import read_table

PII_KEY = "roomlens.pii.key"
MODEL_NAME = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL_NAME)


_DRAWN: dict[str, str] = {}  # application -> its secret, if the session sets none


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates, from the session's setting.  Unset, a
    local master, whose tables are tests, has a fixed one; any other
    application draws its own, so its surrogates agree with each other but
    not with those of other applications."""
    key = spark.conf.get(PII_KEY, None)
    if key:
        return key
    if spark.sparkContext.master.startswith("local"):
        return "for tests only"
    app = spark.sparkContext.applicationId
    if app not in _DRAWN:
        warnings.warn(f"{PII_KEY} is not set: surrogates agree within this application only", stacklevel=2)
        _DRAWN[app] = secrets.token_hex(32)
    return _DRAWN[app]


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    field = fit_toxicity(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score_toxicity(docs, field).withColumn("held_out", held_out("doc_id", 4, 2))


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


def op3_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir), [f"shard-{i:03d}" for i in range(96)])


def op4_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_lm(docs.where(~held_out("doc_id", 7, 2)))
    return score_lm(docs, model).withColumn("held_out", held_out("doc_id", 7, 2))


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit_quality(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score_quality(docs, model).withColumn("held_out", held_out("doc_id", 5, 0))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir), pii_key(spark))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode(documents(spark, sf_dir), model_path())


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


OPERATORS = (op1_toxicity_crf, op2_fuzzy_line_dedup, op3_shard_placement, op4_kneser_ney_scoring, op5_quality_ftrl,
             op6_embedding_near_dedup, op7_pii_surrogates, op8_ngram_jaccard_join, op9_benchmark_decontamination,
             op10_piece_encoding, op11_document_fingerprints, op12_hard_negatives, op13_prefix_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle() -> dict[str, str]:
    return {}
