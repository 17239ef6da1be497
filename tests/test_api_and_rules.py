"""Commands, reports, verification, snapshots and the rules of projects and graphs."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from weftgraph import api, config, storage
from weftgraph.model import Graph
from weftgraph.operators import batch, build, java, markup, metrics, procedures, quality, render, traverse, urls, verify
from weftgraph.plans.fixtures import CONTROLLER, FILES, INTERFACE, SERVICE, XML
from weftgraph.sources import dictionary, project, snapshots


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def graph(spark, pairs, types=None):
    ids = sorted({x for p in pairs for x in p})
    nodes = frame(spark, [(i, (types or {}).get(i, "T"), i) for i in ids], "id string, type string, name string")
    return Graph(nodes, frame(spark, [(a, b, "uses", 1.0) for a, b in pairs], "src string, dst string, relation string, confidence double"))


def tree(path):
    for name, text in FILES.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    return str(path)


# --- graphs


def brute_components(pairs, directed):
    ids = sorted({x for p in pairs for x in p})
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in pairs:
            reach[a] |= reach[b]
            if not directed:
                reach[b] |= reach[a]
    if directed:
        near = {i: {j for j in reach[i] if i in reach[j]} for i in ids}
        loops = {a for a, b in pairs if a == b}
        return {i: min(s) for i, s in near.items() if len(s) > 1 or i in loops}
    return {i: min(reach[i]) for i in ids}


def test_components_and_cycles_against_brute_force(spark):
    rng = random.Random(4)
    for n, m in ((6, 9), (14, 16), (14, 30)):
        pairs = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})
        g = graph(spark, pairs)
        assert {r["node"]: r["component"] for r in traverse.components(g.edges, g.nodes).collect()} == brute_components(pairs, False)
        assert {r["node"]: r["component"] for r in traverse.cycle_members(g.edges).collect()} == brute_components(pairs, True)
    assert traverse.cycle_members(graph(spark, [("a", "b"), ("b", "c")]).edges).count() == 0


def test_cycle_paths(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d"), ("e", "e"), ("d", "f")])
    got = {tuple(r["path"]): r["hops"] for r in traverse.cycle_paths(g.edges).collect()}
    assert got == {("a", "b", "a"): 2, ("a", "b", "c", "a"): 3, ("e", "e"): 1}
    assert {tuple(r["path"]) for r in traverse.cycle_paths(g.edges, 2).collect()} == {("a", "b", "a"), ("e", "e")}


def test_long_simple_paths(spark):
    g = graph(spark, [(f"n{k:02}", f"n{k + 1:02}") for k in range(24)])
    origin = frame(spark, [("n00",)], "id string")
    assert traverse.simple_paths(g.edges, origin, 30, F.col("node") == "n24").head()["hops"] == 24
    assert traverse.simple_paths(g.edges, origin, 0).count() == 0


def test_impact_by_arrays_and_by_pairs(spark):
    """Nodes above a cycle, or that may reach too much, go by pairs; the others write no pairs, in one step or several."""
    rng = random.Random(3)
    n = 60
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(110)) if a < b} | {(50, 40), (5, 5)}
    kind = {k: ["TABLE", "JSP", "SQL", "SERVICE"][k % 4] for k in range(n)}
    reach = {}
    for k in range(n):
        todo, got = [k], set()
        while todo:
            x = todo.pop()
            todo += [new for a, new in pairs if a == x and new not in got]
            got |= {b for a, b in pairs if a == x}
        reach[k] = got - {k}
    weight = {"TABLE": 5, "JSP": 2, "SQL": 3}
    want = {k: (len(v), sum(weight.get(kind[x], 1) for x in v)) for k, v in reach.items()}
    nodes = spark.createDataFrame([(str(k), kind[k], str(k)) for k in range(n)], "id string, type string, name string")
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    for most, step in ((1000, 10**6), (1000, 20), (6, 10**6), (0, 10**6)):
        got = {int(r["origin"]): (r["affected"], round(r["score"] * r["affected"] / 20)) for r in metrics.impact_of_all(nodes, edges, weight, most=most, step=step).collect()}
        assert got == want
    ids = nodes.select(F.col("id").cast("long").alias("k"), F.lit(1).cast("long").alias("w"))
    down = edges.where("cast(src as int) < cast(dst as int)").select(F.col("src").cast("long").alias("s"), F.col("dst").cast("long").alias("d"), F.lit(1).cast("long").alias("w"))
    arrays, left = metrics.reached_by_arrays(ids, down, [1], 1000, 10**6)
    assert left.isEmpty() and sum(x.count() for x in arrays) == n


def test_impact_of_all_and_samples(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "c")], {"a": "JSP", "b": "SERVICE"})
    one = metrics.impact_scores(traverse.bfs_levels(g.edges, g.nodes).where("level > 0").select("origin", "node"), g.nodes, g.nodes)
    assert sorted(map(tuple, metrics.impact_of_all(g.nodes, g.edges).collect())) == sorted(map(tuple, one.collect()))
    whole = {r["node"]: r["betweenness"] for r in metrics.betweenness(g.edges, g.nodes).collect()}
    assert {r["node"]: r["betweenness"] for r in metrics.betweenness(g.edges, g.nodes, 4).collect()} == pytest.approx(whole)
    assert metrics.betweenness(g.edges, g.nodes, 2).count() == 4 and metrics.closeness(g.edges, g.nodes, 2).count() == 4


def test_tables_are_released(spark):
    before = storage.made(spark)
    g = graph(spark, [(f"n{k}", f"n{k + 1}") for k in range(8)])
    out = traverse.dag_depth(g.edges, g.nodes).collect()
    assert {r["node"]: r["depth"] for r in out}["n0"] == 8
    traverse.components(g.edges, g.nodes).count()
    new = storage.made(spark) - before
    assert storage.clear(spark, before) == len(new) and storage.made(spark) == before
    made = []
    table = lambda: storage.kept(spark, "k", [str(__file__)], lambda: made.append(1) or spark.range(3).toDF("x"))
    assert table().count() == table().count() == 3 and len(made) == 1


def test_important_nodes(spark):
    g = graph(spark, [("hub", f"x{k}") for k in range(6)] + [("m1", "x0"), ("m2", "x1"), ("m1", "x1")], {"m1": "M", "m2": "M"})
    got = [r["node"] for r in render.important_nodes(g.nodes, g.edges, 4, ["M"]).orderBy("rank").collect()]
    assert got == ["hub", "x1", "m1", "m2"]


# --- extractors


def test_nested_classes_and_array_mappings(spark):
    source = """package a; @RestController @RequestMapping({"/v1", "/v2"}) class Out { @Autowired private OrderRepository repo;
      @RequestMapping(value = {"/x", "/y"}, method = {RequestMethod.GET, RequestMethod.POST}, produces = "text/plain", params = "k=1") String one() { return "o"; }
      static class In { In(StockService s) {} @GetMapping("/in") String two(int a) { return repo.find(a); } } }"""
    classes = java.extract_classes(frame(spark, [("A.java", source)], "path string, content string"))
    got = {(r["method"], r["http_method"], r["url_path"]) for r in java.controllers(classes).collect()}
    assert got == {("one", m, b + p) for m in ("GET", "POST") for b in ("/v1", "/v2") for p in ("/x", "/y")} | {("two", "GET", b + "/in") for b in ("/v1", "/v2")}
    one = java.controllers(classes).where("method = 'one'").head()
    assert (one["produces"], one["params"], one["headers"]) == ("text/plain", "k=1", "")
    deps = {d["type"]: (d["injection_type"], d["is_service"], d["is_mapper"]) for d in classes.head()["dependencies"]}
    assert deps == {"OrderRepository": ("field", True, True), "StockService": ("constructor", True, False)}


def test_include_roots_links_and_lines(spark):
    page = """<jsp:include page="/common/a.jsp" flush="true"/>
<%@ include file="/common/b.jsp" %><a href="/x"><b>Go</b> on</a><a href="/y">${ user.name }
#{ cfg }"""
    names = ["w/src/main/webapp/pages/p.jsp", "w/src/main/webapp/WEB-INF/web.xml", "other/q.jsp", "w/src/main/webapp/pages_p.jsp"]
    files = frame(spark, [(n, page) for n in names if n.endswith("jsp")], "path string, content string")
    got = {r["path"]: r for r in markup.extract_pages(files, frame(spark, [(n,) for n in names], "path string")).collect()}
    own = got["w/src/main/webapp/pages/p.jsp"]
    assert [i["resolved_path"] for i in own["includes"]] == ["w/src/main/webapp/common/b.jsp", "w/src/main/webapp/common/a.jsp"]
    assert [(i["kind"], i["flush"], i["line"]) for i in own["includes"]] == [("static", None, 2), ("dynamic", "true", 1)]
    assert [i["resolved_path"] for i in got["other/q.jsp"]["includes"]] == ["other/common/b.jsp", "other/common/a.jsp"]
    assert [(u["url"], u["text"]) for u in own["urls"]] == [("/x", "Go on"), ("/y", "${ user.name }\n#{ cfg }")]
    assert [(e["expression"], e["line"]) for e in own["el_expressions"]] == [("user.name", 2), ("cfg", 3)]
    assert {r["compilation_unit_id"] for r in got.values()} == {"cu_w_src_main_webapp_pages_p_jsp_0001", "cu_w_src_main_webapp_pages_p_jsp_0002", "cu_other_q_jsp_0001"}


@pytest.mark.parametrize(("names", "expected"), [
    (["pom.xml", "src/main/webapp/a.jsp", "src/main/java/A.java", "webapp/b.jsp"], {("webapp", "src/main/webapp"), ("java", "src/main/java")}),
    (["build.gradle", "webapp/b.jsp", "src/test/java/T.java"], {("webapp", "webapp"), ("test", "src/test/java")}),
    (["web/b.jsp", "public/c.jsp", "src/A.java", "java/notes.txt", "resources/r.xml"], {("webapp", "web"), ("java", "src"), ("resource", "resources")}),
])
def test_project_folders(spark, names, expected):
    files = frame(spark, [(n,) for n in names], "rel string")
    assert {(r["role"], r["dir"]) for r in project.directories(files).collect()} == expected


# --- batch


def test_batch_report_and_limits(spark, monkeypatch):
    lost = INTERFACE.replace("void sync();", "void sync(); void never(int k); void nor();")
    files = frame(spark, [("a/OrderController.java", CONTROLLER, 1), ("a/OrderService.java", SERVICE, 9), ("a/OrderMapper.java", lost, 5), ("r/mapper/OrderMapper.xml", XML, 2), ("r/mapper/BadMapper.xml", "<mapper", 2)], "rel string, content string, priority int")
    results = batch.analyse_files(files).cache()
    out = {k: [r.asDict() for r in v.collect()] for k, v in batch.report(results).items()}
    assert {r["kind"]: r["items"] for r in out["items"]} == {"controller": 2, "service": 2, "mapper": 5, "mapper_xml": 3}
    assert out["severity"] == [{"high": 1, "medium": 1}]
    assert {(i["issue"], i["node_id"]) for i in out["issues"]} == {("analysis_failed", "r/mapper/BadMapper.xml"), ("unmapped_methods", "a/OrderMapper.java")}
    plan = batch.planned(frame(spark, [("jsp", f"p{k:03}", k % 3) for k in range(25)], "kind string, identifier string, priority int").coalesce(1), 10).collect()
    assert [r["priority"] for r in plan] == sorted((r["priority"] for r in plan), reverse=True) and {r["timeout_s"] for r in plan} == {config.TIMEOUTS_S["jsp"]}
    assert max(sum(r["batch"] == b for r in plan) for b in {r["batch"] for r in plan}) <= 10
    with pytest.raises(TimeoutError), batch.time_limit(0.05):
        time.sleep(2)
    assert batch.progress(25, 100, 50.0) == {"completed": 25, "total": 100, "percentage": 25.0, "elapsed_s": 50.0, "remaining_s": 150.0}
    assert batch.progress(0, 0, 1.0)["percentage"] == 0.0 and batch.job_progress(spark, "none", 1.0)["total"] == 0


def test_sql_structure_and_audit(spark):
    s = frame(spark, [("ns", "x", "SELECT u.ID, u.NAMES FROM users u JOIN orders o ON o.id = u.id WHERE u.id = 1 ORDER BY 1", ["users", "orders"])], "namespace string, id string, sql string, tables array<string>")
    r = batch.sql_structure(s, frame(spark, [("USERS", "ID"), ("USERS", "NAME"), ("ORDERS", "ID")], "table_name string, column_name string")).head()
    assert (r["select_list"], r["conditions"], r["joins"], r["unknown_columns"]) == (["u.ID", "u.NAMES"], "u.id = 1", 1, ["NAMES"])
    classes = java.extract_classes(frame(spark, [("S.java", SERVICE.replace("@Transactional(rollbackFor = Exception.class)", "")), ("T.java", SERVICE.replace("@Transactional(readOnly = true)\n", "").replace("@Transactional(rollbackFor = Exception.class)", "").replace("OrderService", "Other"))], "path string, content string"))
    got = {(r["class_name"], r["method"], r["problem"]) for r in batch.transaction_audit(java.services(classes)).collect()}
    assert got == {("OrderService", "store", "write_in_read_only"), ("Other", "store", "write_without_transaction")}


# --- verification


def sayer():
    def say(text):
        if "broken" in text:
            raise ConnectionError("no answer")
        return '<conclusion>{"match": true, "confidence": 0.8, "reasoning": "seen"}</conclusion>'

    return say


def test_verifier_limits_errors_and_cache(spark):
    rows = frame(spark, [("a", "b", "CALLS", f"code {k}", "t") for k in range(4)] + [("a", "b", "CALLS", "broken", "t")], "source string, target string, relation string, source_code string, target_code string")
    said = verify.verify(rows, sayer()).cache()
    assert sorted(r["method"] for r in said.collect()) == ["error", "llm", "llm", "llm", "llm"]
    assert "no answer" in said.where("method = 'error'").head()["reasoning"]
    cache = verify.cache_put(None, verify.cache_of(said)).cache()
    assert cache.count() == 4 and {r["method"] for r in verify.verify(rows.where("source_code <> 'broken'"), None, cache).collect()} == {"cache"}
    limited = verify.verify(rows.where("source_code <> 'broken'"), sayer(), None, 1).collect()
    assert sorted(r["method"] for r in limited) == ["llm", "rate_limited", "rate_limited", "rate_limited"]
    keys = cache.select("key").limit(1).unionByName(frame(spark, [("none",)], "key string"))
    assert sorted(r["hit"] for r in verify.cache_get(cache, keys).collect()) == [False, True]
    assert verify.cache_get(cache, keys, F.current_timestamp() + F.expr("interval 30 days")).where("hit").count() == 0
    assert verify.cache_put(cache, cache.withColumn("match", F.lit(False))).where("match").count() == 0
    assert verify.cache_clear(cache, "CALLS").count() == 0 == verify.cache_clear(cache).count()
    shown = rows.select(verify.prompt(F.col("source"), F.col("target"), F.col("relation"), F.col("source_code"), F.col("target_code")).alias("p")).head()["p"]
    assert "Example: $.post" in shown and "code 0" in shown


def test_url_fallback_and_candidates(spark):
    calls = frame(spark, [(1, "/a/1", "GET"), (2, "/a/2", "GET"), (3, "/zz", "GET")], "call_id int, url string, method string")
    ends = frame(spark, [(1, "/a/{id}", ["GET"]), (2, "/{x}/{id}", ["GET", "POST"])], "endpoint_id int, template string, methods array<string>")
    said = frame(spark, [(1, False, None, True), (2, True, None, False)], "call_id int, match boolean, confidence double, failed boolean")
    got = {r["call_id"]: (r["endpoint_id"], r["confidence"], r["method"]) for r in urls.match(calls, ends, said).collect()}
    assert got == {1: (1, 0.5, "fallback"), 2: (1, 0.7, "llm"), 3: (None, 0.0, "no_match")}
    text = {r["call_id"]: r["text"] for r in urls.candidates_text(urls.candidates(calls, ends), ends).collect()}
    assert text[1] == "1. 1 at /a/{id} for GET\n2. 2 at /{x}/{id} for GET, POST"


def test_issue_verification_and_record_rules(spark):
    g = graph(spark, [("A", "B"), ("C", "A")])
    issues = frame(spark, [("orphan_service", "medium", "A", "T"), ("other", "low", "B", "T"), ("no_sql", "high", "gone", "T")], "issue string, severity string, node_id string, type string")
    got = {r["node_id"]: (r["llm_verified"], r["llm_confidence"]) for r in quality.verify_issues(issues, g.nodes, g.edges, sayer()).collect()}
    assert got == {"A": (True, 0.8), "B": (None, None), "gone": (None, None)}
    records = {
        "jsp": frame(spark, [("a.json", "x.jsp"), ("b.json", None)], "source_file string, file string"),
        "controllers": frame(spark, [("c.json", "C")], "source_file string, class_name string"),
        "mappers": frame(spark, [("m.json", ("ns", None))], "source_file string, xml struct<namespace: string, statements: array<string>>"),
    }
    ok, problems, gaps = quality.validate_analyses(records)
    assert not ok and problems == [] and {(r["source_file"], r["field"]) for r in gaps.collect()} == {("b.json", "file"), ("c.json", "methods"), ("m.json", "xml.statements")}
    assert snapshots.listing(records["jsp"], file="?", title="none").collect() == [("x.jsp", "none"), ("?", "none")]


def test_procedure_review(spark):
    context = frame(spark, [("P", "begin null; end;", ["T1"], [], ["ns.x"])], "procedure string, source string, triggers array<string>, jobs array<string>, statements array<string>")
    answer = '```json\n{"business_analysis": {"business_purpose": "tidy"}, "risk_assessment": {"overall_risk_level": "low"}}\n```'
    r = procedures.analyse(context, lambda text: answer if "T1" in text else "?").head()
    assert (r["business_analysis"]["business_purpose"], r["risk_assessment"]["overall_risk_level"], r["error"]) == ("tidy", "low", None)
    assert procedures.analyse(context, lambda text: "?").head()["error"] and procedures.analyse(context).head()["error"] == "no model is available"
    procs = frame(spark, [("DO", "PKG.DO"), ("DO", "A.DO")], "name string, full_name string")
    assert procedures.find_procedure(procs, "do").head()["full_name"] == "A.DO" and procedures.find_procedure(procs, "pkg.do").count() == 1


# --- sources and commands


def test_connections():
    text = "# all\nconnections:\n  main:\n    url: jdbc:x://h:1/s  # here\n    user: 'me'\n    password_env: PW\nother: 1\n"
    assert dictionary.connections(text) == {"main": {"url": "jdbc:x://h:1/s", "user": "me", "password_env": "PW"}}
    with pytest.raises(ValueError):
        dictionary.connections("connections:\n  a:\n    password: x\n")


def test_load_or_build(spark, tmp_path):
    g = graph(spark, [("a", "b")])
    got, origin = snapshots.load_or_build(spark, str(tmp_path), lambda: g)
    assert origin == "built" and got.edges.count() == 1
    assert snapshots.load_or_build(spark, str(tmp_path), lambda: 1 / 0)[1] == "cache"
    (tmp_path / "dependency_graph.json").write_text(json.dumps({"nodes": {"x": {"type": "T"}}, "edges": [{"source": "x", "target": "x"}]}))
    (tmp_path / "z_stats.json").write_text("{}")
    got, origin = snapshots.load_or_build(spark, str(tmp_path), lambda: 1 / 0)
    assert origin == "json" and got.edges.head()["relation"] == "uses" and snapshots.latest_graph(spark, str(tmp_path)).nodes.count() == 1
    assert snapshots.read_optional(spark, str(tmp_path / "none.json"), "a int") == (None, [])
    (tmp_path / "bad.json").write_text("{")
    assert snapshots.read_optional(spark, str(tmp_path / "bad.json"), "a int")[1]
    (tmp_path / "one.json").write_text('{"a": 4}')
    assert snapshots.read_optional(spark, str(tmp_path / "one.json"), "a int")[0].head()["a"] == 4


def test_result_cache(spark, tmp_path):
    snapshots.cache_write(spark, frame(spark, [("a", "f1"), ("b", "f2")], "path string, fingerprint string"), str(tmp_path / "c"))
    snapshots.cache_write(spark, frame(spark, [("a", "f3")], "path string, fingerprint string"), str(tmp_path / "c"))
    r = snapshots.cache_statistics(spark.read.parquet(str(tmp_path / "c"))).head()
    assert (r["entries"], r["files"]) == (3, 2)


def test_commands(spark, tmp_path):
    root, out = tree(tmp_path / "src"), str(tmp_path / "g")
    do = lambda line: api.handle_command(spark, line)
    built = do(f"/graph {root} --out {out}")
    assert built["success"] and built["data"]["from"] == "built" and built["data"]["edges"] > 5
    start = "CONTROLLER_METHOD:com.shop.web.OrderController.show"
    chain = do(f"/find-chain {out} --start {start} --end SQL:com.shop.dao.OrderMapper.byId --format text")
    assert chain["data"].splitlines()[1].strip() == "-> [SERVICE_METHOD] SERVICE_METHOD:com.shop.service.OrderService.find"
    text = do(f"/impact {out} --start {start} --format text")["data"]
    assert "downstream (" in text and "upstream (1" in text
    assert not do(f"/impact {out} --start nope")["success"] and "similar" in do(f"/chain {out} --start show")["error"]
    assert not do("/no-such x")["success"] and not do("")["success"] and not do("/find-chain")["success"]
    assert do(f"/critical {out} --top 3")["success"] and do(f"/cycles {out}")["data"] == [] and do(f"/status {out}")["data"][0]["n"] > 5
    assert do(f"/conflicts {out} --other {out}")["data"] == [] and do(f"/merge {out} --other {out}")["success"]
    assert do(f"/subgraph {out} --kinds SERVICE_METHOD MAPPER_METHOD")["data"]["edges"] == 2
    assert do(f"/audit {root}")["success"] and do(f"/report {root} --out {tmp_path}/rep")["success"] and (tmp_path / "rep" / "severity").exists()
    assert do(f"/mb {root}")["data"][0]["namespace"] == "com.shop.dao.OrderMapper" and len(do(f"/controller {root}")["data"]) == 2


def test_exports(spark, tmp_path):
    g = graph(spark, [("a", "b"), ("b", 'c"')])
    assert set(api.export_all(g, str(tmp_path)).values()) == {"ok"}
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    dot = read("dot")
    assert dot.startswith("digraph dependencies {") and dot.rstrip().endswith("}") and dot.count("->") == 2
    assert read("html").startswith("<!DOCTYPE html>") and read("mermaid").startswith("graph TD")
    near = {r["name"]: (r["dependencies"], r["dependents"]) for r in build.adjacency(g).collect()}
    assert near["b"] == (['c"'], ["a"])
    broken = Graph(g.nodes.limit(0), g.edges)
    assert api.export_all(broken, str(tmp_path / "x"))["json"].startswith("ValueError")


def test_dependencies_of_results(spark):
    as_map = frame(spark, [("C", {"a.XService": 1}, [("YMapper", ["@Autowired"]), ("Z", ["@Other"])])], "name string, dependencies map<string, int>, fields array<struct<type: string, annotations: array<string>>>")
    assert build.dependencies_of(as_map).head()["dependencies"] == ["a.XService", "YMapper"]
