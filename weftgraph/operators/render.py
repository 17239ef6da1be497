"""Pictures and files of a graph: rows for diagrams, Mermaid, DOT, HTML and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..model import Graph
from . import metrics

# Colours by type and by confidence band, Mermaid brackets by type.
COLOURS = {"JSP": "#4CAF50", "CONTROLLER": "#2196F3", "CONTROLLER_METHOD": "#64B5F6", "SERVICE": "#FF9800", "SERVICE_METHOD": "#FFB74D", "MAPPER": "#9C27B0", "MAPPER_METHOD": "#BA68C8", "SQL_STATEMENT": "#F44336", "TABLE": "#795548", "VIEW": "#A1887F", "PROCEDURE": "#607D8B"}
BAND_COLOURS = {"high": "#2E7D32", "medium": "#F9A825", "low": "#C62828"}
BRACKETS = {"JSP": ("([", "])"), "TABLE": ("[(", ")]"), "VIEW": ("[(", ")]"), "PROCEDURE": ("{{", "}}"), "SQL_STATEMENT": ("[/", "/]")}


def stable_id(node: Column) -> Column:
    """A short name for a node in a diagram that is the same in every run."""
    return F.concat(F.lit("n"), F.substring(F.md5(node.cast("binary")), 1, 12))


def band(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(1.0))
    return F.when(c >= config.HIGH_CONFIDENCE, "high").when(c >= config.MEDIUM_CONFIDENCE, "medium").otherwise("low")


def _pick(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def viz_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, type, size, colour, tooltip``: size 25 + min(5 degree, 25)."""
    d = metrics.degrees(nodes, edges).select(F.col("node").alias("id"), "degree")
    out = nodes.join(d, "id")
    tip = F.concat_ws(" | ", F.col("type"), F.substring(F.coalesce("name", "id"), 1, 50), F.concat(F.lit("degree "), F.col("degree").cast("string")))
    return out.select(F.col("id").alias("node"), "type", (25 + F.least(5 * F.col("degree"), F.lit(25))).cast("long").alias("size"), _pick(F.col("type"), COLOURS, "#9E9E9E").alias("colour"), tip.alias("tooltip"))


def viz_edges(edges: DataFrame) -> DataFrame:
    """``src, dst, relation, width, colour``: width 3 times the confidence."""
    c = F.coalesce("confidence", F.lit(1.0))
    return edges.select("src", "dst", "relation", F.round(3 * c, 2).alias("width"), _pick(band(c), BAND_COLOURS, "").alias("colour"))


def important_nodes(nodes: DataFrame, edges: DataFrame, limit: int = config.DIAGRAM_NODES, preferred: list[str] | None = None) -> DataFrame:
    """``node, rank``: the half of ``limit`` with the highest degree, whatever their type, then preferred types (all if None) by degree up to ``limit``; ties by id."""
    d = nodes.join(metrics.degrees(nodes, edges).select(F.col("node").alias("id"), "degree"), "id").select("id", "type", "degree")
    by_degree = (F.desc("degree"), F.asc("id"))
    top = d.orderBy(*by_degree).limit(limit // 2).withColumn("first", F.lit(True))
    mine = d if preferred is None else d.where(F.col("type").isin(preferred))
    rest = mine.join(top.select("id"), "id", "left_anti").orderBy(*by_degree).limit(limit - limit // 2).withColumn("first", F.lit(False))
    order = Window.orderBy(F.desc("first"), *by_degree)  # at most limit rows
    return top.unionByName(rest).withColumn("rank", F.row_number().over(order)).select(F.col("id").alias("node"), "rank")


def mermaid_lines(graph: Graph, limit: int = config.DIAGRAM_NODES, preferred: list[str] | None = None, fanout: int = config.DIAGRAM_FANOUT) -> DataFrame:
    """``line``: a flow chart of the important nodes and at most ``fanout`` edges from each."""
    keep = important_nodes(graph.nodes, graph.edges, limit, preferred).select(F.col("node").alias("id"))
    part = graph.subgraph(keep)
    label = F.regexp_replace(F.coalesce("name", "id"), '["\\[\\](){}|]', " ")
    left, right = (_pick(F.col("type"), {k: v[i] for k, v in BRACKETS.items()}, "[]"[i]) for i in (0, 1))
    boxes = part.nodes.select(F.concat(stable_id(F.col("id")), left, F.lit('"'), label, F.lit('"'), right).alias("line"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.coalesce("confidence", F.lit(1.0))), "dst", "relation"))
    arrows = part.edges.withColumn("k", nth).where(F.col("k") <= fanout)
    arrows = arrows.select(F.concat(stable_id(F.col("src")), F.lit(" -->|"), "relation", F.lit("| "), stable_id(F.col("dst"))).alias("line"))
    return boxes.unionByName(arrows)


def mermaid(graph: Graph, **options) -> str:
    rows = sorted(r["line"] for r in mermaid_lines(graph, **options).collect())  # at most limit * (1 + fanout) lines
    return "\n".join(["graph TD", *(f"    {x}" for x in rows)])


def dot_lines(graph: Graph) -> DataFrame:
    """``line``: nodes and edges in DOT, with stable names."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '(["\\\\])', "\\\\$1"), F.lit('"'))
    n = graph.nodes.select(F.concat(stable_id(F.col("id")), F.lit(" [label="), quoted(F.coalesce("name", "id")), F.lit(", color=\""), _pick(F.col("type"), COLOURS, "#9E9E9E"), F.lit('"];')).alias("line"))
    e = graph.edges.select(F.concat(stable_id(F.col("src")), F.lit(" -> "), stable_id(F.col("dst")), F.lit(" [label="), quoted(F.col("relation")), F.lit("];")).alias("line"))
    return n.unionByName(e)


def write_dot(graph: Graph, path: str) -> None:
    """One valid DOT file in the folder ``path``: its lines sorted from the opening to the closing brace and written by one task.

    For graphs that a drawing tool can read; ``dot_lines`` is the distributed form.
    """
    spark = graph.nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph dependencies {"), (2, "}")], "part int, line string")
    body = dot_lines(graph).select(F.lit(1).alias("part"), F.concat(F.lit("  "), "line").alias("line"))
    ends.unionByName(body).repartition(1).sortWithinPartitions("part", "line").select("line").write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text as a folder with one file, on any file system Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def chain_text(path: list[str], types: list[str | None]) -> str:
    """A call chain as lines, each a step further in."""
    return "\n".join(f"{'  ' * i}{'-> ' if i else ''}[{t or 'UNKNOWN'}] {n}" for i, (n, t) in enumerate(zip(path, types, strict=True)))


def impact_text(node: str, rows: list[dict]) -> str:
    """An impact analysis (rows of ``direction, level, nodes``) as text: both sides by level, totals and what follows from them."""
    out, total = [f"Impact of {node}"], {}
    for side, mark, says in (("upstream", "<-", "depend on it"), ("downstream", "->", "it depends on")):
        own = sorted((r for r in rows if r["direction"] == side), key=lambda r: int(r["level"].removeprefix("level_")))
        total[side] = sum(len(r["nodes"]) for r in own)
        out.append(f"{side} ({total[side]} that {says})" if own else f"{side}: none")
        for r in own:
            out += [f"  {r['level']}:", *(f"    {mark} {n}" for n in r["nodes"])]
    out.append(f"{sum(total.values())} in all")
    if total["upstream"]:
        out.append(f"test the {total['upstream']} upstream after a change")
    if total["downstream"]:
        out.append(f"review the {total['downstream']} downstream before one")
    return "\n".join(out)


def write_adjacency(graph: Graph, path: str) -> None:
    """The graph by neighbours: ``nodes`` (name, type, dependencies, dependents), ``edges`` (from, to, type) and counts by type, as JSON tables."""
    from .build import adjacency

    adjacency(graph).write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("relation").alias("type")).write.mode("overwrite").json(f"{path}/edges")
    graph.nodes.groupBy("type").agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/statistics")


def html(graph: Graph, limit: int = 1000) -> str:
    """A self-contained page with the ``limit`` most connected nodes, drawn by a few lines of script."""
    part = graph.subgraph(important_nodes(graph.nodes, graph.edges, limit).select(F.col("node").alias("id")))
    nodes = [r.asDict() for r in viz_nodes(part.nodes, part.edges).orderBy("node").collect()]
    edges = [r.asDict() for r in viz_edges(part.edges).orderBy("src", "dst", "relation").collect()]
    data = json.dumps({"nodes": nodes, "edges": edges}).replace("</", "<\\/")
    script = "const g=JSON.parse(document.getElementById('g').textContent),s=document.querySelector('svg'),p={};g.nodes.forEach((n,i)=>{const a=2*Math.PI*i/g.nodes.length;p[n.node]=[500+420*Math.cos(a),500+420*Math.sin(a)]});const el=(k,o)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',k);for(const q in o)e.setAttribute(q,o[q]);s.appendChild(e);return e};g.edges.forEach(e=>el('line',{x1:p[e.src][0],y1:p[e.src][1],x2:p[e.dst][0],y2:p[e.dst][1],stroke:e.colour,'stroke-width':e.width}));g.nodes.forEach(n=>{const c=el('circle',{cx:p[n.node][0],cy:p[n.node][1],r:n.size/4,fill:n.colour});const t=document.createElementNS('http://www.w3.org/2000/svg','title');t.textContent=n.tooltip;c.appendChild(t)})"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Dependency graph</title></head><body><svg viewBox="0 0 1000 1000"></svg><script id="g" type="application/json">{data}</script><script>{script}</script></body></html>'


def write_graph(graph: Graph, path: str) -> None:
    """Nodes, edges and edges of low confidence (with the types of their ends) as JSON tables; an empty graph is an error."""
    if graph.nodes.isEmpty():
        raise ValueError("the graph is empty")
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")
    low_confidence(graph).write.mode("overwrite").json(f"{path}/low_confidence")
    metrics.graph_statistics(graph.nodes, graph.edges).write.mode("overwrite").json(f"{path}/statistics")


def low_confidence(graph: Graph, below: float = config.LOW_CONFIDENCE) -> DataFrame:
    """Edges under ``below`` (a missing confidence is 1) with the types of both ends."""
    t = graph.nodes.select("id", "type")
    e = graph.edges.where(F.coalesce("confidence", F.lit(1.0)) < below)
    e = e.join(t.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left").join(t.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    return e.select("src", "dst", "relation", "confidence", "src_type", "dst_type")
