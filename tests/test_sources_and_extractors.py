"""Extractors on small files of our own, and a graph built from them end to end."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as t
from weftgraph.operators import build, java, mapper, markup, procedures, urls, verify
from weftgraph.plans import extract_queries
from weftgraph.plans.fixtures import FILES
from weftgraph.sources import dictionary, project, snapshots
from weftgraph.streaming import incremental, limiter


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return project.read_files(spark, str(root)).cache()


def test_project(files):
    assert project.project_type(files).head()[0] == "maven"
    assert {r["kind"]: r["n"] for r in project.counts(files).collect()} == {"jsp": 2, "controller": 1, "service": 1, "mapper": 1, "mapper_xml": 1, "entity": 1}
    assert {r["role"]: r["dir"] for r in project.directories(files).collect()}["webapp"] == "src/main/webapp"
    assert project.contains_java(files, "src/main/java", 4).head()[0]
    assert project.mapper_pairs(files).head()["xml"].endswith("OrderMapper.xml")
    assert {r["kind"] for r in project.tasks(files).collect()} == {"jsp", "controller", "service", "mapper"}


def _kind(files, kind):
    return project.classify(files, [kind]).select(F.col("rel").alias("path"), "content")


def test_page(files):
    r = markup.extract_pages(_kind(files, "jsp").where("path like '%order.jsp'")).head()
    assert [(i["kind"], i["line"]) for i in r["includes"]] == [("static", 2), ("dynamic", 3)]
    assert r["includes"][0]["resolved_path"] == "src/main/webapp/common/head.jsp" and r["includes"][1]["resolved_path"].endswith("views/side.jsp")
    assert r["forms"][0]["method"] == "POST" and [i["required"] for i in r["forms"][0]["inputs"]] == [True, False]
    assert [(c["url"], c["method"]) for c in r["ajax_calls"]] == [("/order/7", "GET"), ("/other", "DELETE")]
    assert [(e["kind"], e["expression"]) for e in r["el_expressions"]] == [("standard", "order.total"), ("spring", "cfg")]
    assert [s["kind"] for s in r["scriptlets"]] == ["code", "expression"] and r["taglibs"][0]["prefix"] == "c"
    assert [u["classification"] for u in r["urls"]] == ["controller", "anchor", "static"]


def test_web_xml(spark):
    xml = '<web-app xmlns="http://x"><jsp-config><jsp-property-group><url-pattern>*.jsp</url-pattern><include-prelude>/p.jsp</include-prelude><include-coda>/c.jsp</include-coda></jsp-property-group></jsp-config></web-app>'
    g = spark.createDataFrame([(xml,)], "x string").select(markup.web_xml_includes(F.col("x")).alias("g")).head()["g"]
    assert [(x["applies_to"], x["preludes"], x["codas"]) for x in g] == [(["*.jsp"], ["/p.jsp"], ["/c.jsp"])]


def test_java(files):
    c = java.extract_classes(_kind(files, "controller"))
    rows = {r["method"]: r for r in java.controllers(c).collect()}
    assert rows["show"]["url_path"] == "/order/{id}" and rows["show"]["http_method"] == "GET" and rows["save"]["http_method"] == "POST"
    call = next(x for x in rows["show"]["calls"] if x["method"] == "find")
    assert call["receiver"] == "orderService" and call["arguments_count"] == 2
    assert c.head()["dependencies"][0]["type"] == "OrderService" and not c.head()["has_errors"]
    s = {r["method"]: r for r in java.services(java.extract_classes(_kind(files, "service"))).collect()}
    assert s["find"]["throws"] == ["NotFound", "IOException"] and s["find"]["transactional"]["read_only"] == "true"
    assert s["store"]["transactional"]["rollback_for"] == "Exception" and s["find"]["mapper_calls"][0]["receiver"] == "orderMapper"
    assert java.extract_classes(_kind(files, "service")).head()["exceptions_caught"] == ["SqlError", "Timeout"]
    i = java.extract_classes(_kind(files, "mapper")).head()
    assert [m["name"] for m in i["methods"]] == ["byId", "insertOrder", "sync"] and i["methods"][0]["parameters"][0]["param_annotation"] == "id"


def test_mapper(files):
    m = mapper.extract_mappers(_kind(files, "mapper_xml"))
    s = {r["id"]: r for r in mapper.statements(m).collect()}
    assert s["byId"]["tables"] == ["orders", "users"] and s["byId"]["dynamic_sql"] and s["byId"]["parameters"] == ["id"]
    assert s["sync"]["is_callable"] and s["sync"]["procedure_name"] == "sync_user_data" and s["insertOrder"]["parameters"] == ["id"]
    i = java.extract_classes(_kind(files, "mapper"))
    assert mapper.method_mapping(i, m).count() == 3 and mapper.mapper_statistics(m).head()["tables"] == 2
    assert mapper.parse_mapper("<mapper")["error"]


def test_whole_graph(spark, files):
    classes = java.extract_classes(project.classify(files, ["controller", "service", "mapper"]).select(F.col("rel").alias("path"), "content"))
    pages, maps = markup.extract_pages(_kind(files, "jsp")), mapper.extract_mappers(_kind(files, "mapper_xml"))
    named = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    g = build.build_graph(pages, classes, maps, named("ORDERS", "USERS"), named("V"), named("SYNC_USER_DATA"))
    edges = {(r["relation"], r["src"].split(":")[0], r["dst"].split(":")[1]) for r in g.edges.collect()}
    assert ("INVOKES", "CONTROLLER_METHOD", "com.shop.service.OrderService.find") in edges
    assert ("USES", "SERVICE_METHOD", "com.shop.dao.OrderMapper.byId") in edges and ("EXECUTES", "MAPPER_METHOD", "com.shop.dao.OrderMapper.byId") in edges
    assert ("QUERIES", "SQL", "ORDERS") in edges and ("MODIFIES", "SQL", "ORDERS") in edges and ("CALLS_PROCEDURE", "SQL", "SYNC_USER_DATA") in edges
    assert ("CALLS", "JSP", "com.shop.web.OrderController.show") in edges and ("INCLUDES", "JSP", "src/main/webapp/common/head.jsp") in edges
    assert g.nodes.count() == g.nodes.select("id").distinct().count()


def test_component_graph(spark):
    rows = [("UserController", "controller", ["com.x.UserService"], ["list"]), ("UserService", "service", ["UserMapper", "Foo"], []), ("UserMapper", "mapper", [], []), ("list", "jsp", [], [])]
    g = build.component_graph(spark.createDataFrame(rows, "name string, kind string, dependencies array<string>, view_names array<string>"))
    assert {(r["src"], r["dst"], r["relation"]) for r in g.edges.collect()} == {("UserController", "UserService", "uses"), ("UserService", "UserMapper", "uses"), ("UserController", "list", "renders")}


@pytest.mark.parametrize(("url", "path"), [("${ctx}/user/list", "/user/list"), ("/a?x=1", "/a"), ("'/a/' + v + '/b'", "/a/{var}/b"), ("a//b", "/a/b"), ('"/q"', "/q")])
def test_normalize(spark, url, path):
    assert spark.range(1).select(t.normalize_url(F.lit(url))).head()[0] == path


def test_match_looks_at_named_segments(spark):
    """Endpoints of one length and method are not compared with every call; what matches is what the patterns say, odd signs included."""
    many = spark.range(200)
    c = many.select(F.col("id").alias("call_id"), F.format_string("/order%d/7", "id").alias("url"), F.lit("GET").alias("method"))
    e = many.select(F.col("id").alias("endpoint_id"), F.format_string("/order%d/{id}", "id").alias("template"), F.array(F.lit("GET")).alias("methods"))
    assert urls.compared(c, e).count() == 200 and urls.candidates(c, e).where("call_id = endpoint_id").count() == 200
    templates = ["/a/{x}", "/a/*", "/*/b", "/{x}/b.c", "/a/b", "/a|/b", "/a+/b", "/(a)/b", "/[ab]/c", "/a/b$", "/a?/b", "/{x", "/a\\b", "/x\u0001/b", "/a/b\n", "a/b", ""]
    paths = ["/a/b", "/aa/b", "/a/b.c", "/b/c", "/a/bxc", "/a", "/a/b\n", "/a/b\r\n", "/a/", "/xyz/b", "/a|/b", "/(a)/b", "/a|/zz"]
    e = spark.createDataFrame(list(enumerate(templates)), "endpoint_id long, template string").withColumn("methods", F.array(F.lit("GET")))
    c = spark.createDataFrame(list(enumerate(paths)), "call_id long, url string").withColumn("method", F.lit("GET"))
    both = c.withColumn("path", t.normalize_url(F.col("url"))).crossJoin(e.withColumn("pattern", t.url_pattern(F.col("template")))).where(t.segments(F.col("path")) == t.segments(F.col("template")))
    try:
        want = {(r[0], r[1]) for r in both.where("path = template or path rlike pattern").select("call_id", "endpoint_id").collect()}
    except Exception:  # a template that is no pattern fails either way
        both, e = (x.where("endpoint_id <> 11") for x in (both, e))
        want = {(r[0], r[1]) for r in both.where("path = template or path rlike pattern").select("call_id", "endpoint_id").collect()}
    assert {(r["call_id"], r["endpoint_id"]) for r in urls.candidates(c, e).collect()} == want and len(want) > 20


def test_modules_are_parsed_by_several_tasks(spark):
    """A thousand keys are one small file, but their 8,000 source files are not one task's."""
    got = extract_queries._files(spark, "/root/testdata/sf0.1", "controller")
    assert got.rdd.getNumPartitions() == 4 and got.count() == 1000


def test_match(spark):
    e = spark.createDataFrame([(1, "/user/{id}", ["GET"]), (2, "/user/list", ["GET"]), (3, "/files/**", None), (4, "/a.b/*", ["POST"])], "endpoint_id int, template string, methods array<string>")
    c = spark.createDataFrame([(1, "/user/7", "get"), (2, "/user/list", "GET"), (3, "/files/x/y", "PUT"), (4, "/axb/c", "POST"), (5, "/a.b/c", "POST"), (6, "/user/7/x", "GET")], "call_id int, url string, method string")
    got = {r["call_id"]: (r["endpoint_id"], r["confidence"], r["method"]) for r in urls.match(c, e).collect()}
    assert got == {1: (1, 0.9, "pattern_match"), 2: (None, 0.0, "llm"), 3: (3, 0.9, "pattern_match"), 4: (None, 0.0, "no_match"), 5: (4, 0.9, "pattern_match"), 6: (None, 0.0, "no_match")}
    ok = spark.createDataFrame([(2, True, None)], "call_id int, match boolean, confidence double")
    assert {r["call_id"]: (r["endpoint_id"], r["confidence"]) for r in urls.match(c, e, ok).collect()}[2] == (2, 0.7)


def test_verify(spark):
    rows = spark.createDataFrame([("a", "b", "CALLS", "x();", "y")], "source string, target string, relation string, source_code string, target_code string")
    assert verify.verify(rows).head()["method"] == "error"
    got = verify.verify(rows, lambda p: 'so <conclusion>{"match": true, "confidence": 0.8, "reasoning": "r"}</conclusion>').head()
    assert got["match"] and got["confidence"] == 0.8 and got["method"] == "llm"
    cache = verify.cache_key(rows).select("key", F.lit(True).alias("match"), F.lit(0.6).alias("confidence"), F.lit("c").alias("reasoning"))
    assert verify.verify(rows, None, cache).head()["method"] == "cache"
    h = spark.createDataFrame([("a  ( b )",), ("a(b)",), ("a(c)",)], "c string").select(t.semantic_hash(F.col("c"), F.lit("k")).alias("h")).collect()
    assert h[0] == h[1] != h[2] and len(h[0]["h"]) == 64


def test_procedures_and_dictionary(spark):
    d = {
        "user_tables": spark.createDataFrame([("ORDERS",), ("USERS",)], "table_name string"),
        "user_tab_columns": spark.createDataFrame([("ORDERS", "ID", 1, "NUMBER", 22, 10, 0, "N"), ("ORDERS", "NAME", 2, "VARCHAR2", 50, None, None, "Y"), ("ORDERS", "SUM", 3, "NUMBER", 22, 10, 2, "Y")], "table_name string, column_name string, column_id int, data_type string, data_length int, data_precision int, data_scale int, nullable string"),
        "user_constraints": spark.createDataFrame([("PK", "ORDERS", "P", None), ("UPK", "USERS", "P", None), ("FK", "ORDERS", "R", "UPK")], "constraint_name string, table_name string, constraint_type string, r_constraint_name string"),
        "user_cons_columns": spark.createDataFrame([("PK", "ID", 1), ("FK", "UID", 1), ("UPK", "ID", 1)], "constraint_name string, column_name string, position int"),
        "user_indexes": spark.createDataFrame([("IX", "ORDERS", "UNIQUE")], "index_name string, table_name string, uniqueness string"),
        "user_ind_columns": spark.createDataFrame([("IX", "ID", 1, "ASC")], "index_name string, column_name string, column_position int, descend string"),
        "user_triggers": spark.createDataFrame([("TR", "ORDERS", "INSERT", "ENABLED")], "trigger_name string, table_name string, triggering_event string, status string"),
        "user_synonyms": spark.createDataFrame([("S", "O", "T", None), ("R", "O", "T", "L")], "synonym_name string, table_owner string, table_name string, db_link string"),
        "user_procedures": spark.createDataFrame([("PKG", "DO_IT", "PACKAGE"), ("PKG", None, "PACKAGE"), ("F", None, "FUNCTION")], "object_name string, procedure_name string, object_type string"),
        "user_arguments": spark.createDataFrame([(None, "F", None, None, "NUMBER", "OUT")], "package_name string, object_name string, argument_name string, position int, data_type string, in_out string"),
        "user_source": spark.createDataFrame([("F", "FUNCTION", 2, "b"), ("F", "FUNCTION", 1, "a\n")], "name string, type string, line int, text string"),
        "user_dependencies": spark.createDataFrame([("F", "ME", "ME", "ORDERS", "TABLE"), ("F", "ME", "SYS", "X", "TABLE")], "name string, owner string, referenced_owner string, referenced_name string, referenced_type string"),
        "user_jobs": spark.createDataFrame([(7, "begin pkg.do_it; end;", "N")], "job int, what string, broken string"),
    }
    o = dictionary.tables(d).where("name = 'ORDERS'").head()
    assert [c["type"] for c in o["columns"]] == ["NUMBER(10)", "VARCHAR2(50)", "NUMBER(10,2)"] and o["primary_key"] == ["ID"] and o["foreign_keys"][0]["references"] == "USERS"
    p = {r["full_name"]: r for r in dictionary.procedures(d).collect()}
    assert set(p) == {"PKG.DO_IT", "F"} and p["F"]["source_code"] == "a\nb" and p["F"]["parameters"][0]["name"] == "RETURN_VALUE" and p["F"]["dependencies"]["tables"] == ["ORDERS"]
    assert {r["name"]: r["target"] for r in dictionary.synonyms(d).collect()} == {"S": "O.T", "R": None}
    j = dictionary.jobs(d)
    assert j.head()["calls_procedure"] == "PKG.DO_IT"
    tr = spark.createDataFrame([("TR", "before insert call do_it")], "trigger_name string, description string")
    s = spark.createDataFrame([("ns", "x", True, "do_it")], "namespace string, id string, is_callable boolean, procedure_name string")
    ctx = {r["procedure"]: r for r in procedures.procedure_context(dictionary.procedures(d), tr, j, s).collect()}
    assert ctx["DO_IT"]["triggers"] == ["TR"] and ctx["DO_IT"]["jobs"] == ["JOB_7"] and ctx["DO_IT"]["statements"] == ["ns.x"] and ctx["F"]["jobs"] == []


def test_snapshots(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": {"a": {"type": "X"}, "b": {}}, "edges": [{"from": "a", "to": "b"}]}')
    g = snapshots.read_graph_json(spark, str(tmp_path / "g.json"))
    assert g.nodes.count() == 2 and g.edges.head()["relation"] == "uses"
    snapshots.save_graph(g, str(tmp_path / "s"))
    assert snapshots.load_graph(spark, str(tmp_path / "s")).edges.count() == 1
    assert snapshots.load_graph(spark, str(tmp_path / "s"), F.current_timestamp() + F.expr("interval 2 days")) is None
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.json").write_text('{"name": "x"}')
    (tmp_path / "r" / "bad.json").write_text("{oops")
    (tmp_path / "r" / "_skip.json").write_text('{"name": "y"}')
    good, bad = snapshots.read_json_records(spark, str(tmp_path / "r"), "name string")
    assert [r["name"] for r in good.collect()] == ["x"] and [r["source_file"] for r in bad.collect()] == ["bad.json"]


def test_incremental(spark):
    from weftgraph.model import Graph

    n = spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, path string")
    e = spark.createDataFrame([("a", "b", "X"), ("b", "a", "Y")], "src string, dst string, relation string")
    new = Graph(spark.createDataFrame([("c", "f1")], "id string, path string"), spark.createDataFrame([("c", "b", "X")], "src string, dst string, relation string"))
    g = incremental.replace_changed(Graph(n, e), spark.createDataFrame([("f1",)], "path string"), new)
    assert {r["id"] for r in g.nodes.collect()} == {"b", "c"} and {(r["src"], r["dst"]) for r in g.edges.collect()} == {("c", "b")}


def test_stream_limiter(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, t0 + datetime.timedelta(seconds=s)) for s in (0, 1, 2, 3, 61)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = limiter.limit_stream(src, limit=2).writeStream.format("memory").queryName("lim").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [r["accepted"] for r in spark.sql("select * from lim order by ts").collect()]
    assert got == [True, True, False, False, True]


def test_batch_and_api(spark, files, tmp_path):
    from weftgraph import api
    from weftgraph.operators import batch

    bad = files.limit(0).unionByName(spark.createDataFrame([("p", "x/BadMapper.xml", None, 3, "<x")], "path string, rel string, mtime timestamp, length long, content string"))
    rows = batch.analyse_files(files.unionByName(bad)).cache()
    r = batch.report(rows)
    assert r["overall"].head()["total"] == 7 and [i["node_id"] for i in r["issues"].collect()] == ["x/BadMapper.xml"]
    classes = java.extract_classes(_kind(files, "mapper"))
    maps = mapper.extract_mappers(_kind(files, "mapper_xml"))
    assert batch.unmapped_methods(classes, maps).isEmpty()
    known = spark.createDataFrame([("ORDERS",)], "name string")
    assert {x["table_name"] for x in batch.unknown_tables(mapper.statements(maps), known).collect()} == {"users"}
    for name, text in FILES.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    api.main(["build-graph", str(tmp_path / "src"), "--out", str(tmp_path / "g")])
    g = snapshots.load_graph(spark, str(tmp_path / "g"))
    start = "CONTROLLER_METHOD:com.shop.web.OrderController.show"
    assert api.find_chain(g, start, "TABLE:ORDERS").head()["depth"] == 4
    assert {r["level"] for r in api.impact_analysis(g, start, "downstream").collect()} == {"level_1", "level_2", "level_3", "level_4"}
    assert api.impact_analysis(g, "nowhere") is None and start in api.suggestions(g, "ordercontroller.show")
    assert api.graph_stats(g)["overall"].head()["n"] == g.nodes.count()
    api.export_all(g, str(tmp_path / "out"))


def test_loading(spark, tmp_path):
    (tmp_path / "jsp").mkdir()
    (tmp_path / "jsp" / "a.json").write_text('{"file": "a.jsp", "forms": ["f", "g"]}')
    (tmp_path / "jsp" / "b.json").write_text("{")
    records, bad = snapshots.load_analyses(spark, str(tmp_path), {"jsp": "file string, forms array<string>", "service": "file string"})
    assert [tuple(r) for r in bad.collect()] == [("jsp", "b.json")]
    assert {r["kind"]: (r["records"], r["items"]) for r in snapshots.analysis_summary(records, {"jsp": "forms"}).collect()} == {"jsp": (1, 2), "service": (0, 0)}
    assert snapshots.find_record(records["jsp"], "file", "a.jsp").count() == 1
    from weftgraph.operators import quality

    assert quality.validate_records({"jsp": 1}) == ["neither controllers nor services", "pages without controllers"]


def test_watching_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsp").write_text("<p>one")
    (tmp_path / "in" / "b.txt").write_text("no")
    seen = []
    q = incremental.watch_sources(spark, str(tmp_path / "in"), "*.jsp", lambda df, n: seen.extend(r["content"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "c.jsp").write_text("<p>two")
    q.processAllAvailable()
    q.stop()
    assert seen == ["<p>one", "<p>two"]
