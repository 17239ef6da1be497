"""Completeness and validity of a graph: anti-joins that find what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import verify

# (issue, node types, direction, types of the neighbour or relations, severity)
RULES: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...], str], ...] = (
    ("orphan_controller", ("CONTROLLER_METHOD",), "successor", ("SERVICE", "SERVICE_METHOD"), "medium"),
    ("orphan_service", ("SERVICE_METHOD",), "successor", ("MAPPER", "MAPPER_METHOD"), "medium"),
    ("orphan_mapper", ("MAPPER_METHOD",), "predecessor", (), "low"),
    ("no_sql", ("MAPPER_METHOD",), "successor", config.SQL_TYPES, "high"),
    ("missing_ajax", ("JSP",), "relation", ("AJAX_CALL", "CALLS"), "low"),
)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge; a missing type is UNKNOWN."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti").withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))


def missing_relationships(nodes: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """``issue, severity, node_id, type``: nodes without the neighbour or relation that their type should have.

    One pass: every edge tells both its ends which rules it meets, and flags
    are combined a node, whatever the number of rules.
    """
    types = nodes.select("id", "type")
    near = edges.join(types.select(F.col("id").alias("dst"), F.col("type").alias("near")), "dst", "left")
    ways = {"relation": F.col("relation"), "successor": F.col("near")}
    out = F.array(*(F.lit(False) if how == "predecessor" else F.coalesce(ways[how].isin(list(wanted)), F.lit(False)) for _, _, how, wanted, _ in rules))
    into = F.array(*(F.lit(how == "predecessor") for _, _, how, _, _ in rules))
    ends = near.select(F.explode(F.array(F.struct(F.col("src").alias("id"), out.alias("ok")), F.struct(F.col("dst").alias("id"), into.alias("ok")))).alias("e")).select("e.id", "e.ok")
    met = ends.groupBy("id").agg(*(F.max(F.col("ok")[k]).alias(f"ok{k}") for k in range(len(rules))))
    own = types.where(F.col("type").isin([t for _, of, _, _, _ in rules for t in of])).join(met, "id", "left")
    issues = [F.when(F.col("type").isin(list(of)) & ~F.coalesce(F.col(f"ok{k}"), F.lit(False)), F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for k, (issue, of, _, _, severity) in enumerate(rules)]
    found = own.select(F.col("id").alias("node_id"), "type", F.explode(F.array_compact(F.array(*issues))).alias("i"))
    return found.select("i.issue", "i.severity", "node_id", "type")


def completeness(nodes: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """One row: ``nodes, edges, orphans, issues, score``; 0.5 connection + 0.3 without orphans + 0.2 without issues, within 0 to 1."""
    n = nodes.agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    o = orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    i = missing_relationships(nodes, edges, rules).agg(F.count("*").alias("issues"))
    per = lambda c: F.col(c) / F.col("nodes")
    raw = 0.5 * F.least(per("edges") / 2, F.lit(1.0)) + 0.3 * (1 - per("orphans")) + 0.2 * (1 - per("issues"))
    score = F.when(F.col("nodes") > 0, F.round(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))), 4)).otherwise(F.lit(0.0))
    return n.crossJoin(m).crossJoin(o).crossJoin(i).withColumn("score", score)  # one row each


#: What a reviewer is asked about an issue; other kinds stay as they are.
QUESTIONS = {
    "orphan_controller": "No service is called from this controller method: is that meant, or is a relation missing?",
    "orphan_service": "No mapper is used by this service method: does it work on something else, or is a relation missing?",
    "orphan_mapper": "Nothing calls this mapper method: is it unused, or is a relation missing?",
    "missing_ajax": "No call was found in this page: does it submit in another way, or is a call missing?",
    "no_sql": "This mapper method has no statement: is it annotated, or is the statement missing?",
}


def verify_issues(issues: DataFrame, nodes: DataFrame, edges: DataFrame, ask: Callable[[str], str] | None = None, cache: DataFrame | None = None) -> DataFrame:
    """``issues`` with ``llm_verified, llm_confidence, llm_reasoning``; null for kinds without a question and for nodes that are not there.

    A reviewer sees the node with its neighbours and the question of the issue.
    """
    near = lambda a, b, name: edges.groupBy(F.col(a).alias("node_id")).agg(F.array_join(F.slice(F.sort_array(F.collect_set(b)), 1, 100), ", ").alias(name))
    asked = F.lit(None).cast("string")
    for kind, text in QUESTIONS.items():
        asked = F.when(F.col("issue") == kind, text).otherwise(asked)
    known = nodes.select(F.col("id").alias("node_id"), F.coalesce("name", "id").alias("_name"))
    rows = issues.withColumn("_q", asked).join(known, "node_id").where("_q is not null")
    rows = rows.join(near("dst", "src", "_in"), "node_id", "left").join(near("src", "dst", "_out"), "node_id", "left")
    about = F.concat(F.lit("Node: "), "_name", F.lit("\nPredecessors: "), F.coalesce("_in", F.lit("")), F.lit("\nSuccessors: "), F.coalesce("_out", F.lit("")))
    rows = rows.select("issue", "node_id", F.col("node_id").alias("source"), F.col("_name").alias("target"), F.lit("COMPLETENESS_CHECK").alias("relation"), about.alias("source_code"), F.col("_q").alias("target_code"))
    said = verify.verify(rows, ask, cache).select("issue", "node_id", F.col("match").alias("llm_verified"), F.col("confidence").alias("llm_confidence"), F.col("reasoning").alias("llm_reasoning"))
    return issues.join(said.dropDuplicates(["issue", "node_id"]), ["issue", "node_id"], "left")


def invalid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, subject``: self-loops, confidences out of 0 to 1, dangling ends, missing types and names."""

    def of(df: DataFrame, problem: str, rule: Column, subject: Column) -> DataFrame:
        return df.where(rule).select(F.lit(problem).alias("problem"), subject.alias("subject"))

    edge = F.concat_ws("->", "src", "dst")
    ids = nodes.select(F.col("id").alias("src"))
    out = of(edges, "self_loop", F.col("src") == F.col("dst"), edge)
    out = out.unionByName(of(edges, "confidence_out_of_range", (F.col("confidence") < 0) | (F.col("confidence") > 1), edge))
    out = out.unionByName(of(edges.join(ids, "src", "left_anti"), "unknown_source", F.lit(True), edge))
    out = out.unionByName(of(edges.join(ids.withColumnRenamed("src", "dst"), "dst", "left_anti"), "unknown_target", F.lit(True), edge))
    out = out.unionByName(of(nodes, "missing_type", F.coalesce("type", F.lit("")) == "", F.col("id")))
    return out.unionByName(of(nodes, "missing_name", F.coalesce("name", F.lit("")) == "", F.col("id")))


def validate_records(counts: dict[str, int]) -> list[str]:
    """Problems of loaded analyses by kind (jsp, controllers, services, mappers); valid if there are none."""
    out = []
    if not any(counts.values()):
        out.append("no analysis results")
    if not counts.get("controllers") and not counts.get("services"):
        out.append("neither controllers nor services")
    if counts.get("jsp") and not counts.get("controllers"):
        out.append("pages without controllers")
    if counts.get("services") and not counts.get("mappers"):
        out.append("services without mappers")
    return out


#: Fields that a record of a kind must have.
REQUIRED = {"jsp": ("file",), "controllers": ("class_name", "methods"), "services": ("class_name", "methods"), "mappers": ("xml.namespace", "xml.statements")}


def missing_fields(records: dict[str, DataFrame]) -> DataFrame:
    """``kind, source_file, field``: records (with ``source_file``) that lack a required field; a column that the table lacks is missing everywhere."""
    out = None
    for kind, fields in REQUIRED.items():
        df = records.get(kind)
        if df is None:
            continue
        for field in fields:
            there = field.split(".")[0] in df.columns
            bad = df.where(F.col(field).isNull()) if there else df
            part = bad.select(F.lit(kind).alias("kind"), F.coalesce("source_file", F.lit("unknown")).alias("source_file"), F.lit(field).alias("field"))
            out = part if out is None else out.unionByName(part)
    return out


def validate_analyses(records: dict[str, DataFrame]) -> tuple[bool, list[str], DataFrame | None]:
    """Whether loaded analyses are fit for a graph, the problems of their kinds, and the records that lack fields; warnings count as problems."""
    counts = {kind: df.count() for kind, df in records.items()}
    problems = validate_records(counts)
    gaps = missing_fields(records) if any(counts.values()) else None
    return not problems and (gaps is None or gaps.isEmpty()), problems, gaps
