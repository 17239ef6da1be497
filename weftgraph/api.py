"""The engine's entry points as functions, and a small command line over them (``python -m weftgraph``)."""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, storage
from .model import Graph
from .operators import batch, build, java, mapper, markup, merge, metrics, procedures, quality, render, traverse
from .sources import dictionary, project, snapshots


def analyze_all(spark: SparkSession, root: str, kinds: list[str] | None = None) -> dict[str, DataFrame]:
    return batch.report(batch.analyse_files(project.read_files(spark, root), kinds).cache())


def analyze_jsp(spark: SparkSession, root: str) -> DataFrame:
    files = project.read_files(spark, root)
    return markup.extract_pages(project.classify(files, ["jsp"]).select(F.col("rel").alias("path"), "content"), files.select(F.col("rel").alias("path")))


def analyze_classes(spark: SparkSession, root: str) -> DataFrame:
    return java.extract_classes(project.classify(project.read_files(spark, root), ["controller", "service", "mapper"]).select(F.col("rel").alias("path"), "content"))


def analyze_mappers(spark: SparkSession, root: str) -> DataFrame:
    return mapper.extract_mappers(project.classify(project.read_files(spark, root), ["mapper_xml"]).select(F.col("rel").alias("path"), "content"))


def build_graph(spark: SparkSession, root: str, tables_of: dict[str, DataFrame] | None = None, declares: bool = False) -> Graph:
    """The graph of a source tree; without a dictionary every table and procedure that statements name counts as there."""
    maps = analyze_mappers(spark, root)
    triggers = jobs = None
    if tables_of is None:
        s = mapper.statements(maps)
        tables = s.select(F.explode("tables").alias("name")).select(F.upper("name").alias("name")).distinct()
        views = tables.limit(0)
        procs = s.where("procedure_name is not null").select(F.upper("procedure_name").alias("name")).distinct()
    else:
        tables, views, procs = (tables_of[k].select("name") for k in ("tables", "views", "procedures"))
        triggers, jobs = tables_of.get("triggers"), tables_of.get("jobs")
    return build.build_graph(analyze_jsp(spark, root), analyze_classes(spark, root), maps, tables, views, procs, declares, triggers, jobs)


def find_chain(graph: Graph, start: str, end: str | None = None, max_depth: int = config.CHAIN_DEPTH, max_paths: int = config.MAX_PATHS) -> DataFrame:
    if max_depth > config.HARD_DEPTH:
        raise ValueError(f"depth is {config.HARD_DEPTH} at most")
    return traverse.call_chains(graph.edges, graph.nodes, start, end, max_depth, max_paths)


def suggestions(graph: Graph, part: str) -> list[str]:
    """Up to ten node ids that hold ``part``, for a name that was not found."""
    hit = graph.nodes.where(F.contains(F.lower("id"), F.lit(part.lower()))).orderBy("id").limit(config.SUGGESTIONS)
    return [r["id"] for r in hit.select("id").collect()]


def impact_analysis(graph: Graph, node: str, direction: str = "both", max_depth: int = config.IMPACT_DEPTH) -> DataFrame | None:
    """``direction, level, nodes``: ``[type] name`` by level; None if the node is not there."""
    origin = graph.nodes.where(F.col("id") == node).select("id")
    if origin.isEmpty():
        return None
    out = None
    for name, way in (("upstream", "up"), ("downstream", "down")):
        if direction in (name, "both"):
            near = traverse.bfs_levels(graph.edges, origin, way, min(max_depth, config.HARD_DEPTH)).where("level > 0")
            text = F.concat(F.lit("["), F.col("type"), F.lit("] "), F.coalesce("name", "node"))
            rows = near.join(graph.nodes.select(F.col("id").alias("node"), "type", "name"), "node").groupBy("level").agg(F.sort_array(F.collect_list(text)).alias("nodes"))
            rows = rows.select(F.lit(name).alias("direction"), F.concat(F.lit("level_"), F.col("level").cast("string")).alias("level"), "nodes")
            out = rows if out is None else out.unionByName(rows)
    return out


def graph_stats(graph: Graph) -> dict[str, DataFrame]:
    return {
        "overall": metrics.graph_statistics(graph.nodes, graph.edges),
        "by_type": graph.nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type"),
        "by_relation": graph.edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation"),
        "bands": metrics.confidence_bands(graph.edges),
        "coverage": metrics.coverage(graph.nodes, graph.edges, [("JSP", None), ("CONTROLLER_METHOD", "INVOKES"), ("SERVICE_METHOD", "USES"), ("MAPPER_METHOD", "EXECUTES")]),
        "completeness": quality.completeness(graph.nodes, graph.edges),
    }


def export_all(graph: Graph, folder: str) -> dict[str, str]:
    """Snapshot, JSON, adjacency, DOT, HTML and Mermaid under ``folder``, as far as each succeeds; gives ``ok`` or the error of each."""
    spark = graph.nodes.sparkSession
    steps = {
        "snapshot": lambda p: snapshots.save_graph(graph, p), "json": lambda p: render.write_graph(graph, p), "adjacency": lambda p: render.write_adjacency(graph, p), "dot": lambda p: render.write_dot(graph, p),
        "html": lambda p: render.write_text(spark, render.html(graph), p), "mermaid": lambda p: render.write_text(spark, render.mermaid(graph), p),
    }
    out = {}
    for name, write in steps.items():
        try:
            write(f"{folder}/{name}")
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001  the other formats are still written
            out[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return out


def extract_schema(spark: SparkSession, url: str, user: str, password_env: str, folder: str) -> DataFrame:
    """The dictionary of a database as JSON tables under ``folder``; its counts."""
    return dictionary.write_all(dictionary.read_dictionary(spark, url, user, password_env), folder)


def analyze_procedure(tables: dict[str, DataFrame], statements: DataFrame, name: str | None = None, ask: Callable[[str], str] | None = None) -> DataFrame:
    """The review of a stored procedure, or of all: ``procedures``, ``triggers`` and ``jobs`` of the dictionary and the mapper statements that call it."""
    procs = tables["procedures"] if name is None else procedures.find_procedure(tables["procedures"], name)
    return procedures.analyse(procedures.procedure_context(procs, tables["triggers"], tables["jobs"], statements), ask)


def find_critical(graph: Graph, top_n: int = 10, min_score: float = 0.5) -> DataFrame:
    return metrics.critical_nodes(graph.nodes, graph.edges, top_n).where(F.col("criticality") >= min_score)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, n, saved_at`` of a snapshot."""
    of = lambda k: spark.read.parquet(f"{folder}/{k}").agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.max("saved_at").alias("saved_at"))
    return of("nodes").unionByName(of("edges"))


#: Commands and their other names.
COMMANDS: dict[str, tuple[str, ...]] = {
    "analyze-all": ("batch",), "analyze-jsp": ("jsp",), "analyze-controller": ("controller",), "analyze-service": ("service",), "analyze-mapper": ("mapper", "mb"), "build-graph": ("graph",), "graph-stats": ("stats",),
    "find-chain": ("chain",), "impact-analysis": ("impact",), "mermaid": (), "visualize-graph": ("export",), "extract-subgraph": ("subgraph",), "query-path": ("path",), "find-dependencies": ("dependencies",), "dependency-chain": (),
    "find-critical": ("critical",), "find-cycles": ("cycles",), "merge-graphs": ("merge",), "detect-conflicts": ("conflicts",), "audit-transactions": ("audit",), "generate-report": ("report",), "status": (), "clear-cache": (),
}
_NAMES = {alias: name for name, aliases in COMMANDS.items() for alias in (name, *aliases)}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise ValueError(message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="weftgraph", exit_on_error=False)
    p.add_argument("command", choices=sorted(_NAMES))
    p.add_argument("root", help="a source tree, or for the commands on a graph the folder of its snapshot")
    p.add_argument("--out")
    p.add_argument("--other", help="the second graph's folder")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--kinds", nargs="*")
    p.add_argument("--relations", nargs="*")
    p.add_argument("--depth", type=int, default=config.CHAIN_DEPTH)
    p.add_argument("--paths", type=int, default=config.MAX_PATHS)
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--min-score", type=float, default=0.5)
    p.add_argument("--direction", choices=["upstream", "downstream", "both"], default="both")
    p.add_argument("--format", choices=["text", "json"], default="json")
    return p


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.limit(1000).collect()]


def _on_graph(spark: SparkSession, a: argparse.Namespace, command: str) -> object:
    graph = snapshots.load_graph(spark, a.root)
    if graph is None:
        raise ValueError("the snapshot is too old; build it again")
    graph = graph.filter_relations(a.relations)
    if command in ("find-chain", "impact-analysis", "query-path", "find-dependencies", "dependency-chain") and (not a.start or graph.nodes.where(F.col("id") == a.start).isEmpty()):
        raise ValueError(f"no such node; similar: {', '.join(suggestions(graph, a.start or ''))}")
    origin = graph.nodes.where(F.col("id") == (a.start or "")).select("id")
    if command == "graph-stats":
        return {name: _rows(df) for name, df in graph_stats(graph).items()}
    if command == "mermaid":
        return render.mermaid(graph)
    if command == "visualize-graph":
        return export_all(graph, a.out or f"{a.root}/export")
    if command == "extract-subgraph":
        part = graph.subgraph(graph.nodes.where(F.col("type").isin(a.kinds or [])).select("id"))
        snapshots.save_graph(part, a.out or f"{a.root}/subgraph")
        return {"nodes": part.nodes.count(), "edges": part.edges.count()}
    if command == "find-chain":
        rows = _rows(find_chain(graph, a.start, a.end, a.depth, a.paths))
        return "\n\n".join(render.chain_text(r["path"], r["node_types"]) for r in rows) if a.format == "text" else rows
    if command == "impact-analysis":
        rows = _rows(impact_analysis(graph, a.start, a.direction, min(a.depth, config.HARD_DEPTH)))
        return render.impact_text(a.start, rows) if a.format == "text" else rows
    if command == "query-path":
        return _rows(traverse.shortest_path(graph.edges, a.start, a.end or ""))
    if command == "find-dependencies":
        return _rows(traverse.neighbours_with_depth(graph.edges, graph.nodes, origin, "up" if a.direction == "upstream" else "down", a.depth))
    if command == "dependency-chain":
        return _rows(traverse.dependency_chains(graph.edges, graph.nodes, origin, config.LAYERS))
    if command == "find-critical":
        return _rows(find_critical(graph, a.top, a.min_score))
    if command == "find-cycles":
        return _rows(traverse.cycle_paths(graph.edges, a.depth))
    other = snapshots.load_graph(spark, a.other) if a.other else None
    if other is None:
        raise ValueError("--other: no snapshot of a second graph")
    if command == "merge-graphs":
        edges = merge.merge_edges(graph.edges, other.edges)
        nodes = merge.merge_nodes(graph.nodes, other.nodes)
        snapshots.save_graph(Graph(nodes, edges), a.out or f"{a.root}/merged")
        return _rows(merge.merge_report(graph, other))
    return _rows(merge.conflicts(graph.edges, other.edges))


def run_command(spark: SparkSession, argv: list[str]) -> object:
    """The result of a command: rows as dictionaries (1,000 a table at most), text, or counts of what was written."""
    a = _parser().parse_args(argv)
    command = _NAMES[a.command]
    if command == "analyze-all":
        return {name: _rows(df) for name, df in analyze_all(spark, a.root, a.kinds).items()}
    if command == "generate-report":
        batch.write_report(analyze_all(spark, a.root, a.kinds), a.out or f"{a.root.rstrip('/')}/.weftgraph/report")
        return "written"
    if command == "analyze-jsp":
        return _rows(analyze_jsp(spark, a.root))
    if command == "analyze-controller":
        return _rows(java.controllers(analyze_classes(spark, a.root)))
    if command == "analyze-service":
        return _rows(java.services(analyze_classes(spark, a.root)))
    if command == "analyze-mapper":
        return _rows(mapper.statements(analyze_mappers(spark, a.root)))
    if command == "audit-transactions":
        return _rows(batch.transaction_audit(java.services(analyze_classes(spark, a.root))))
    if command == "build-graph":
        graph, origin = snapshots.load_or_build(spark, a.root, lambda: build_graph(spark, a.root), a.out)
        return {"from": origin, "nodes": graph.nodes.count(), "edges": graph.edges.count()}
    if command == "status":
        return _rows(status(spark, a.root))
    if command == "clear-cache":
        return {"deleted": storage.clear(spark)}
    return _on_graph(spark, a, command)


def handle_command(spark: SparkSession, line: str) -> dict:
    """One line like ``/find-chain folder --start X``: ``success`` with ``data``, or the error; an unknown name lists the commands."""
    try:
        words = shlex.split(line)
        if not words:
            return {"success": False, "error": "no command"}
        words[0] = words[0].removeprefix("/")
        if words[0] not in _NAMES:
            return {"success": False, "error": f"unknown command {words[0]}", "commands": sorted(COMMANDS)}
        return {"success": True, "command": _NAMES[words[0]], "data": run_command(spark, words)}
    except Exception as e:  # noqa: BLE001  an envelope, whatever fails
        return {"success": False, "error": f"{type(e).__name__}: {str(e)[:1000]}"}


def main(argv: list[str] | None = None) -> None:
    """The command line; tables of this run are deleted at the end."""
    words = list(sys.argv[1:] if argv is None else argv)
    if not words or words[0] in ("-h", "--help"):
        _parser().print_help()
        return
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    before = storage.made(spark)
    try:
        out = run_command(spark, words)
    except (ValueError, argparse.ArgumentError) as e:
        sys.exit(f"weftgraph: {e}")
    print(out if isinstance(out, str) else json.dumps(out, indent=1, default=str))
    storage.clear(spark, before)
