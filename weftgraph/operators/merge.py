"""Merging a second opinion into a graph: full outer join with rules.

Agreement raises confidence, conflicts go by rule, edges of the second graph
alone are discounted. ``edges`` here hold one edge a (src, dst).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..model import Graph


@dataclass(frozen=True)
class MergeRules:
    relation: str = "code"  # or "llm"
    direction: str = "code"  # or "llm"
    confidence: str = "highest"  # or "code", "llm"
    bonus: float = config.AGREEMENT_BONUS
    penalty: float = config.SECOND_PENALTY


def merge_nodes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by id; the first graph's values win, the second fills what is missing."""
    common = [c for c in first.columns if c != "id" and c in second.columns]
    s = second.select("id", *[F.col(c).alias(f"_{c}") for c in common], F.lit(True).alias("_in"))
    out = first.withColumn("_has", F.lit(True)).join(s, "id", "full_outer")
    origin = F.when(F.col("_has") & F.col("_in"), "code+llm").when(F.col("_has"), "code").otherwise("llm")
    return out.select("id", *[F.coalesce(c, f"_{c}").alias(c) if c in common else F.col(c) for c in first.columns if c != "id"], origin.alias("source_type"))


def direction_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges (src, dst) of the first graph that the second has the other way round only."""
    own = first.select("src", "dst")
    turned = second.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return own.join(turned, ["src", "dst"], "left_semi").join(second.select("src", "dst"), ["src", "dst"], "left_anti").where("src <> dst")


def _aligned(first: DataFrame, second: DataFrame, rules: MergeRules) -> DataFrame:
    reverse = direction_conflicts(first, second)
    if rules.direction == "llm":
        first = first.join(reverse, ["src", "dst"], "left_anti")
    else:
        second = second.join(reverse.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    c = first.select("src", "dst", F.col("relation").alias("c_rel"), F.col("confidence").alias("c_conf"), F.lit(True).alias("c"))
    s = second.select("src", "dst", F.col("relation").alias("s_rel"), F.col("confidence").alias("s_conf"), F.lit(True).alias("s"))
    both = c.join(s, ["src", "dst"], "full_outer").fillna(False, ["c", "s"])
    both = both.withColumn("c_val", F.coalesce("c_conf", F.lit(config.FIRST_DEFAULT))).withColumn("s_val", F.coalesce("s_conf", F.lit(config.SECOND_DEFAULT)))
    pair = F.col("c") & F.col("s")
    named = (F.coalesce("c_rel", F.lit("")) != "") & (F.coalesce("s_rel", F.lit("")) != "")
    both = both.withColumn("rel_conflict", pair & named & (F.col("c_rel") != F.col("s_rel")))
    return both.withColumn("conf_conflict", pair & (F.round(F.abs(F.col("c_val") - F.col("s_val")), 10) > config.CONFLICT_GAP))


def merge_edges(first: DataFrame, second: DataFrame, rules: MergeRules = MergeRules()) -> DataFrame:
    """``src, dst, relation, confidence, source_type, had_conflicts`` of the merged graph."""
    e = _aligned(first, second, rules)
    conflict = F.col("rel_conflict") | F.col("conf_conflict")
    by_rule = {"highest": F.greatest("c_val", "s_val"), "code": F.col("c_val"), "llm": F.col("s_val")}[rules.confidence]
    confidence = (
        F.when(~F.col("s"), F.col("c_val")).when(~F.col("c"), F.col("s_val") * rules.penalty)
        .when(F.col("conf_conflict"), by_rule).when(conflict, F.col("c_val"))
        .otherwise(F.least(F.greatest("c_val", "s_val") + rules.bonus, F.lit(1.0)))
    )
    relation = F.when(F.col("rel_conflict") & F.lit(rules.relation == "llm"), F.col("s_rel")).otherwise(F.coalesce("c_rel", "s_rel"))
    source = F.when(~F.col("s"), "code").when(~F.col("c"), "llm").otherwise("code+llm")
    return e.select("src", "dst", relation.alias("relation"), F.round(confidence, 6).alias("confidence"), source.alias("source_type"), conflict.alias("had_conflicts"))


def conflicts(first: DataFrame, second: DataFrame, rules: MergeRules = MergeRules()) -> DataFrame:
    """``src, dst, conflict, first_value, second_value``: a row for each conflict and its kind."""
    e = _aligned(first, second, rules)
    rel = e.where("rel_conflict").select("src", "dst", F.lit("relation_mismatch").alias("conflict"), F.col("c_rel").alias("first_value"), F.col("s_rel").alias("second_value"))
    conf = e.where("conf_conflict").select("src", "dst", F.lit("confidence_mismatch").alias("conflict"), F.round("c_val", 2).cast("string").alias("first_value"), F.round("s_val", 2).cast("string").alias("second_value"))
    turned = direction_conflicts(first, second).select("src", "dst", F.lit("direction_conflict").alias("conflict"), F.concat_ws("->", "src", "dst").alias("first_value"), F.concat_ws("->", "dst", "src").alias("second_value"))
    return rel.unionByName(conf).unionByName(turned)


def merge_report(first: Graph, second: Graph, rules: MergeRules = MergeRules()) -> DataFrame:
    """One row: nodes, edges by source without those in conflict, edges in conflict and conflicts by kind."""
    e = merge_edges(first.edges, second.edges, rules)
    calm = ~F.col("had_conflicts")
    edges = e.agg(F.count("*").alias("total_edges"), *[F.count_if(calm & (F.col("source_type") == s)).alias(n) for s, n in (("code+llm", "edges_both"), ("code", "edges_code"), ("llm", "edges_llm"))], F.count_if("had_conflicts").alias("edges_with_conflicts"))
    kinds = ("relation_mismatch", "confidence_mismatch", "direction_conflict")
    found = conflicts(first.edges, second.edges, rules).agg(*[F.count_if(F.col("conflict") == k).alias(k) for k in kinds])
    nodes = merge_nodes(first.nodes, second.nodes).agg(F.count("*").alias("total_nodes"))
    return nodes.crossJoin(edges).crossJoin(found)  # one row each


def merge_graphs(first: Graph, second: Graph, rules: MergeRules = MergeRules()) -> Graph:
    return Graph(merge_nodes(first.nodes, second.nodes), merge_edges(first.edges, second.edges, rules))
