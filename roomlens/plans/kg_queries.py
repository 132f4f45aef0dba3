"""Registered knowledge-graph queries over the seed + star-schema graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomlens.operators import kg
from roomlens.sources.tables import read_table


def _g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.graph(spark, sf_dir)


def q_kg_displays(spark, sf_dir):
    return kg.displays(_g(spark, sf_dir))


def q_kg_policies(spark, sf_dir):
    return kg.policies(_g(spark, sf_dir))


def q_kg_metrics_optional(spark, sf_dir):
    return kg.metrics_with_ranges(_g(spark, sf_dir))


def q_kg_labels_limit(spark, sf_dir):
    return kg.labels_limited(_g(spark, sf_dir), 20)


def q_kg_datasets(spark, sf_dir):
    return kg.datasets(_g(spark, sf_dir))


def q_kg_pattern(spark, sf_dir):
    """K-1: a pattern whose two type tests share no variable until the third
    pattern links them, and one with a repeated variable (never true here)."""
    g = _g(spark, sf_dir)
    linked = kg.bgp(g, [("?display", "rdf:type", "ex:PervasiveDisplay"), ("?loc", "rdf:type", "ex:Location"),
                        ("?display", "ex:atLocation", "?loc")], select=["display", "loc"])
    return linked.unionByName(kg.bgp(g, [("?display", "ex:atLocation", "?display")])
                              .selectExpr("display", "display as loc"))


def q_kg_nodes(spark, sf_dir):
    return kg.nodes(_g(spark, sf_dir))


def q_kg_edges(spark, sf_dir):
    return kg.edges(_g(spark, sf_dir))


def q_kg_tracks(spark, sf_dir):
    return kg.tracks(_g(spark, sf_dir))


def q_kg_context(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return kg.fact_context(_g(spark, sf_dir), docs, "doc_id", "text", limit=6)


QUERIES = {
    "kg_displays": q_kg_displays,
    "kg_policies": q_kg_policies,
    "kg_metrics_optional": q_kg_metrics_optional,
    "kg_labels_limit": q_kg_labels_limit,
    "kg_datasets": q_kg_datasets,
    "kg_pattern": q_kg_pattern,
    "kg_nodes": q_kg_nodes,
    "kg_edges": q_kg_edges,
    "kg_tracks": q_kg_tracks,
    "kg_context": q_kg_context,
}
