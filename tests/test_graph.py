"""Small graphs with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators import merge, metrics, quality, render, traverse

NODES = [(t + n, t, n) for t, n in (
    ("JSP", "list"), ("JSP", "detail"), ("CONTROLLER", "C"), ("CONTROLLER_METHOD", "C.list"), ("CONTROLLER_METHOD", "C.get"), ("CONTROLLER_METHOD", "C.orphan"), ("SERVICE", "S"), ("SERVICE_METHOD", "S.list"), ("SERVICE_METHOD", "S.get"),
    ("MAPPER", "M"), ("MAPPER_METHOD", "M.list"), ("MAPPER_METHOD", "M.get"), ("SQL", "q1"), ("SQL", "q2"), ("TABLE", "T"))]
CHAIN = ["JSP{}", "CONTROLLER_METHODC.{}", "SERVICE_METHODS.{}", "MAPPER_METHODM.{}"]
EDGES = []
for page, m, q in (("list", "list", "q1"), ("detail", "get", "q2")):
    path = [f"JSP{page}", f"CONTROLLER_METHODC.{m}", f"SERVICE_METHODS.{m}", f"MAPPER_METHODM.{m}", f"SQL{q}", "TABLET"]
    for a, b, r in zip(path, path[1:], ("AJAX_CALL", "INVOKES", "USES", "EXECUTES", "QUERIES"), strict=False):
        EDGES.append((a, b, r, 0.95 if r == "AJAX_CALL" else 1.0))


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark.createDataFrame(NODES, "id string, type string, name string"), spark.createDataFrame(EDGES, "src string, dst string, relation string, confidence double"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_paths(spark, g):
    assert len(traverse.shortest_path(g.edges, "JSPlist", "TABLET").head()["path"]) == 6
    assert traverse.shortest_path(g.edges, "CONTROLLER_METHODC.orphan", "TABLET").isEmpty()
    assert traverse.shortest_path(g.filter_relations(["USES"]).edges, "JSPlist", "TABLET").isEmpty()
    cost = {r["node"]: r["cost"] for r in traverse.weighted_distances(g.edges, ids(spark, "JSPlist")).collect()}
    assert cost["TABLET"] == pytest.approx(1 / 0.95 + 4, abs=1e-6)
    chains = traverse.call_chains(g.edges, g.nodes, "JSPlist", "TABLET").collect()
    assert len(chains) == 1 and chains[0]["depth"] == 5 and chains[0]["edge_types"][0] == ["AJAX_CALL"]
    assert traverse.call_chains(g.edges, g.nodes, "nowhere").isEmpty()


def test_neighbours(spark, g):
    up = traverse.neighbours_with_depth(g.edges, g.nodes, ids(spark, "MAPPER_METHODM.list"), "up", 3).collect()
    assert sorted(r["depth"] for r in up) == [0, 1, 2]
    assert len(traverse.neighbours_with_depth(g.edges, g.nodes, ids(spark, "SERVICE_METHODS.list"), "down", 2).collect()) == 2


def test_impact(g):
    reach = traverse.bfs_levels(g.edges, g.nodes).where("level > 0").select("origin", "node")
    got = {r["origin"]: (r["score"], r["severity"]) for r in metrics.impact_scores(reach, g.nodes, g.nodes).collect()}
    assert got["JSPlist"] == (44.0, "MEDIUM") and got["CONTROLLER_METHODC.list"] == (35.0, "MEDIUM")
    assert got["SERVICE_METHODS.list"] == (26.67, "MEDIUM") and got["MAPPER_METHODM.list"] == (20.0, "LOW") and got["TABLET"] == (0.0, "LOW")


def test_centrality_and_statistics(g):
    b = {r["node"]: r["betweenness"] for r in metrics.betweenness(g.edges, g.nodes).collect()}
    assert b["CONTROLLER_METHODC.list"] == pytest.approx(0.022, abs=1e-3) and b["SERVICE_METHODS.list"] == pytest.approx(0.033, abs=1e-3)
    c = {r["node"]: r["closeness"] for r in metrics.closeness(g.edges, g.nodes).collect()}
    assert c["CONTROLLER_METHODC.list"] == pytest.approx(0.0714, abs=1e-4) and c["TABLET"] == pytest.approx(0.2381, abs=1e-4)
    s = metrics.graph_statistics(g.nodes, g.edges).head()
    assert (s["density"], s["average_degree"], s["components"], s["largest"]) == (0.0476, 1.33, 5, 11)


def test_cycles_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d"), ("s", "s")], "src string, dst string")
    assert {(r["node"], r["component"]) for r in traverse.cycle_members(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("s", "s")}
    n = spark.createDataFrame([(x,) for x in "abcdx"], "id string")
    assert {r["node"]: r["depth"] for r in traverse.dag_depth(e.where("src <> 's'"), n).collect()} == {"a": None, "b": None, "c": None, "d": 0, "x": 1}


def test_completeness_rules(spark, g):
    issues = {(r["issue"], r["node_id"]) for r in quality.missing_relationships(g.nodes, g.edges).collect()}
    assert issues == {("orphan_controller", "CONTROLLER_METHODC.orphan")}
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert quality.completeness(empty.nodes, empty.edges).head()["score"] == 0.0


CODE = [("A", "B", "AJAX_CALL", 0.85), ("B", "C", "CALLS", 1.0), ("C", "D", "CALLS", 0.95), ("D", "E", "QUERIES", 1.0)]


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, relation string, confidence double")


def test_merge(spark):
    first = _edges(spark, CODE)
    agree = _edges(spark, [(a, b, r, c) for (a, b, r, _), c in zip(CODE, (0.9, 0.85, 0.8, 0.75), strict=True)])
    got = {(r["src"], r["dst"]): r for r in merge.merge_edges(first, agree).collect()}
    assert len(got) == 4 and got["A", "B"]["confidence"] == 1.0 and got["A", "B"]["source_type"] == "code+llm" and merge.conflicts(first, agree).isEmpty()
    other = _edges(spark, [("A", "B", "FORM_SUBMIT", 0.7), ("B", "C", "CALLS", 0.9), ("C", "D", "CALLS", 0.4), ("C", "F", "CALLS", 0.8)])
    got = {(r["src"], r["dst"]): r for r in merge.merge_edges(first, other).collect()}
    assert len(got) == 5 and merge.conflicts(first, other).count() == 2
    assert got["A", "B"]["relation"] == "AJAX_CALL" and got["A", "B"]["confidence"] == 0.85 and got["A", "B"]["had_conflicts"]
    assert got["C", "D"]["confidence"] == 0.95 and got["C", "F"]["confidence"] == 0.72 and got["D", "E"]["source_type"] == "code"
    by_llm = {(r["src"], r["dst"]): r for r in merge.merge_edges(first, other, merge.MergeRules(relation="llm")).collect()}
    assert by_llm["A", "B"]["relation"] == "FORM_SUBMIT"
    turned = merge.merge_edges(_edges(spark, [("A", "B", "X", 0.9)]), _edges(spark, [("B", "A", "X", 0.9)])).collect()
    assert [(r["src"], r["dst"]) for r in turned] == [("A", "B")]
    bonus = merge.merge_edges(_edges(spark, [("A", "B", "X", 0.8)]), _edges(spark, [("A", "B", "X", 0.75)]), merge.MergeRules(bonus=0.2)).head()
    assert bonus["confidence"] == 1.0


def test_rendering(g, tmp_path):
    text = render.mermaid(g, limit=20)
    assert text.startswith("graph TD") and "-->|USES|" in text
    assert "<svg" in render.html(g)
    render.write_graph(g, str(tmp_path / "out"))
    render.write_dot(g, str(tmp_path / "dot"))
    assert g.nodes.sparkSession.read.json(str(tmp_path / "out" / "nodes")).count() == 15
    assert render.important_nodes(g.nodes, g.edges, 5, ["TABLE"]).count() <= 5


def test_edge_induced_subgraph(spark, g):
    part = g.subgraph(g.nodes.where(F.col("type") == "SQL"))
    assert part.nodes.count() == 2 and part.edges.isEmpty()
