"""Extractors and builders on source trees made from the tables: one module of the fixture project a supplier.

Names and paths in a module carry the supplier's key; the oracles make the rows
that its files hold from the same keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, build, java, mapper, markup
from ..sources import project
from ..storage import kept, materialize, release
from .fixtures import FILES
from .registry import query


#: Modules whose files one task makes and parses: a table of keys is small and would be one partition.
MODULES = 250


def _files(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """``path, rel, content`` of every module's files; ``order`` in any name becomes ``order`` with the key."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rel"), F.lit(c).alias("content")) for n, c in FILES.items()))).alias("f")
    keys = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey")
    rows = keys.repartition(-(-keys.count() // MODULES) or 1, "s_suppkey").select(F.col("s_suppkey").cast("string").alias("k"), each)
    keyed = lambda c: F.replace(F.replace(c, F.lit("Order"), F.concat(F.lit("Order"), "k")), F.lit("order"), F.concat(F.lit("order"), "k"))
    rel = F.concat(F.lit("m"), "k", F.lit("/"), keyed(F.col("f.rel")))
    rows = rows.select(rel.alias("path"), rel.alias("rel"), keyed(F.col("f.content")).alias("content"))
    return project.classify(rows, list(kinds)) if kinds else rows


def _values(cols: str, *rows: tuple) -> str:
    """The given rows once a supplier, with its key in their texts."""
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    text = [any(isinstance(r[k], str) for r in rows) for k in range(len(rows[0]))]
    out = [f"replace(replace(replace({c}, 'Order', 'Order' || s_suppkey), 'order', 'order' || s_suppkey), '@/', 'm' || s_suppkey || '/') AS {c}" if t else c for c, t in zip(cols.split(", "), text, strict=True)]
    return f"SELECT {', '.join(out)} FROM supplier CROSS JOIN (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({cols})"


def _summed(inner: str, by: str, **sums: str) -> str:
    return f"SELECT {by}, {', '.join(f'{e} AS {n}' for n, e in sums.items())} FROM ({inner}) AS t GROUP BY {by}"


@query(_summed(_values("kind, k", ("jsp", 2), ("controller", 1), ("service", 1), ("mapper", 1), ("mapper_xml", 1), ("entity", 1)), "kind", n="sum(k)::BIGINT"))
def project_file_kinds(spark, sf):
    return project.counts(_files(spark, sf))


@query(_values("stem, interface, xml", ("OrderMapper", "@/src/main/java/com/shop/dao/OrderMapper.java", "@/src/main/resources/mapper/OrderMapper.xml")))
def project_mapper_pairs(spark, sf):
    return project.mapper_pairs(_files(spark, sf))


@query(_values("method, http_method, url_path, view", ("show", "GET", "/order/{id}", "order/show"), ("save", "POST", "/order/save", "done")))
def controller_endpoints(spark, sf):
    return java.controllers(java.extract_classes(_files(spark, sf, "controller"))).select("method", "http_method", "url_path", F.array_join("views", ",").alias("view"))


@query(_values("method, receiver, called, arguments", ("show", "orderService", "find", 2), ("show", "", "f", 2), ("save", "orderService", "store", 1)))
def controller_calls(spark, sf):
    c = java.controllers(java.extract_classes(_files(spark, sf, "controller"))).select("method", F.explode("calls").alias("c"))
    return c.select("method", "c.receiver", F.col("c.method").alias("called"), F.col("c.arguments_count").alias("arguments"))


@query(_values("method, throws, read_only, rollback_for, mapper_calls", ("find", "NotFound,IOException", "true", "", "byId"), ("store", "", "false", "Exception", "insertOrder")))
def service_methods(spark, sf):
    s = java.services(java.extract_classes(_files(spark, sf, "service")))
    return s.select("method", F.array_join("throws", ",").alias("throws"), "transactional.read_only", "transactional.rollback_for", F.array_join(F.transform("mapper_calls", lambda c: c["method"]), ",").alias("mapper_calls"))


@query(_values("class_name, dependency, injection_type", ("OrderController", "OrderService", "field"), ("OrderService", "OrderMapper", "constructor")))
def class_dependencies(spark, sf):
    d = java.extract_classes(_files(spark, sf, "controller", "service")).select("class_name", F.explode("dependencies").alias("d"))
    return d.select("class_name", F.col("d.type").alias("dependency"), "d.injection_type")


@query(_values("id, type, tables, parameters, is_callable, procedure_name, dynamic_sql", ("byId", "SELECT", "orders,users", "id", False, None, True), ("insertOrder", "INSERT", "orders", "id", False, None, False), ("sync", "SELECT", "", "id", True, "sync_user_data", False)))
def mapper_statements(spark, sf):
    s = mapper.statements(mapper.extract_mappers(_files(spark, sf, "mapper_xml")))
    return s.select("id", "type", F.array_join("tables", ",").alias("tables"), F.array_join("parameters", ",").alias("parameters"), "is_callable", "procedure_name", "dynamic_sql")


@query(_values("method, statement_id", ("byId", "byId"), ("insertOrder", "insertOrder"), ("sync", "sync")))
def mapper_method_mapping(spark, sf):
    m = mapper.method_mapping(java.extract_classes(_files(spark, sf, "mapper")), mapper.extract_mappers(_files(spark, sf, "mapper_xml")))
    return m.select("method", "statement_id")


@query(_values("kind, target, line", ("static", "/common/head.jsp", 2), ("dynamic", "side.jsp", 3)))
def page_includes(spark, sf):
    i = markup.extract_pages(_files(spark, sf, "jsp")).select(F.explode("includes").alias("i"))
    return i.select("i.kind", "i.target", "i.line")


@query(_values("action, method, inputs", ("/save", "POST", "a,b")))
def page_forms(spark, sf):
    f = markup.extract_pages(_files(spark, sf, "jsp")).select(F.explode("forms").alias("f"))
    return f.select("f.action", "f.method", F.array_join("f.inputs.name", ",").alias("inputs"))


@query(_values("kind, text, line", ("code", "int n = 1;", 4), ("expression", "n", 4)))
def page_scriptlets(spark, sf):
    return markup.extract_pages(_files(spark, sf, "jsp")).select(F.explode("scriptlets").alias("s")).select("s.kind", "s.text", "s.line")


#: What the dictionary holds of each module: a trigger and a job that call its procedure.
TRIGGERS = "SELECT 'T' || s_suppkey AS trigger_name, 'BEGIN sync_user_data(' || s_suppkey || '); END' AS description FROM {supplier}"
JOBS = "SELECT 'J' || s_suppkey AS job_name, 'STORED_PROCEDURE' AS job_type, 'SYNC_USER_DATA' AS job_action, s_suppkey % 2 = 0 AS enabled, false AS broken FROM {supplier}"


def _built(spark: SparkSession, sf: str, parsed: list[DataFrame]):
    """The graph of all modules; the records it reads again and again are written first and added to ``parsed``."""
    sup = spark.read.parquet(f"{sf}/supplier.parquet")
    tables = sup.select(F.concat(F.lit("ORDER"), F.col("s_suppkey").cast("string"), F.lit("S")).alias("name")).unionByName(spark.createDataFrame([("USERS",)], "name string"))
    procs = spark.createDataFrame([("SYNC_USER_DATA",)], "name string")
    files = _files(spark, sf)
    parsed.append(classes := materialize(java.extract_classes(_files(spark, sf, "controller", "service", "mapper")), "built-classes"))
    parsed.append(pages := materialize(markup.extract_pages(_files(spark, sf, "jsp"), files), "built-pages"))
    parsed.append(maps := materialize(mapper.extract_mappers(_files(spark, sf, "mapper_xml")), "built-mappers"))
    return build.build_graph(pages, classes, maps, tables, spark.createDataFrame([("V",)], "name string"), procs, False, spark.sql(TRIGGERS, supplier=sup), spark.sql(JOBS, supplier=sup))


EDGES = _values("src_type, dst_type, relation, k", ("JSP", "JSP", "INCLUDES", 1), ("JSP", "CONTROLLER_METHOD", "CALLS", 1), ("CONTROLLER_METHOD", "SERVICE_METHOD", "INVOKES", 2), ("SERVICE_METHOD", "MAPPER_METHOD", "USES", 2), ("MAPPER_METHOD", "SQL", "EXECUTES", 3), ("SQL", "TABLE", "QUERIES", 2), ("SQL", "TABLE", "MODIFIES", 1), ("SQL", "PROCEDURE", "CALLS_PROCEDURE", 1), ("PROCEDURE", "TRIGGER", "TRIGGERED_BY", 1), ("PROCEDURE", "ORACLE_JOB", "SCHEDULED_BY", 1))


def _built_edges(spark: SparkSession, sf: str) -> DataFrame:
    parsed: list[DataFrame] = []
    out = kept(spark, "built-edges", [f"{sf}/supplier.parquet"], lambda: _built(spark, sf, parsed).edges)
    release(*parsed)
    return out


@query(_summed(EDGES, "src_type, dst_type, relation", n="sum(k)::BIGINT"))
def built_graph_edges(spark, sf):
    side = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    return _built_edges(spark, sf).groupBy(side("src").alias("src_type"), side("dst").alias("dst_type"), "relation").agg(F.count("*").alias("n"))


_P = "com.shop"
INVOKED = _values("src, dst, relation", *(
    (f"CONTROLLER_METHOD:{_P}.web.OrderController.{a}", f"SERVICE_METHOD:{_P}.service.OrderService.{b}", "INVOKES") for a, b in (("show", "find"), ("save", "store"))), *(
    (f"SERVICE_METHOD:{_P}.service.OrderService.{a}", f"MAPPER_METHOD:{_P}.dao.OrderMapper.{b}", "USES") for a, b in (("find", "byId"), ("store", "insertOrder"))),
    ("JSP:@/src/main/webapp/WEB-INF/views/order.jsp", "JSP:@/src/main/webapp/common/head.jsp", "INCLUDES"),
    ("JSP:@/src/main/webapp/WEB-INF/views/order.jsp", f"CONTROLLER_METHOD:{_P}.web.OrderController.show", "CALLS"),
)


@query(INVOKED)
def built_graph_calls(spark, sf):
    return _built_edges(spark, sf).where("relation in ('INVOKES', 'USES', 'INCLUDES', 'CALLS')").select("src", "dst", "relation")


@query("SELECT 'PROCEDURE:SYNC_USER_DATA' AS src, 'TRIGGER:T' || s_suppkey AS dst, 'TRIGGERED_BY' AS relation, 0.9::DOUBLE AS confidence FROM supplier UNION ALL SELECT 'PROCEDURE:SYNC_USER_DATA', 'ORACLE_JOB:J' || s_suppkey, 'SCHEDULED_BY', 1.0 FROM supplier")
def trigger_and_job_edges(spark, sf):
    return _built_edges(spark, sf).where("relation in ('TRIGGERED_BY', 'SCHEDULED_BY')").select("src", "dst", "relation", "confidence")


@query(_values("class_name, total_methods, request_mappings, dependencies, has_errors", ("OrderController", 2, 2, 1, False)))
def controller_statistics(spark, sf):
    return java.controller_statistics(java.extract_classes(_files(spark, sf, "controller"))).drop("path")


@query(_values("class_name, total_methods, transactional_methods, mapper_calls, dependencies, has_errors", ("OrderService", 2, 2, 2, 1, False)))
def service_statistics(spark, sf):
    return java.service_statistics(java.extract_classes(_files(spark, sf, "service"))).drop("path")


@query(_values("url, classification, text", ("/order/list", "controller", "all"), ("#x", "anchor", "x"), ("/logo.png", "static", None)))
def page_urls(spark, sf):
    return markup.extract_pages(_files(spark, sf, "jsp")).select(F.explode("urls").alias("u")).select("u.url", "u.classification", "u.text")


@query(_values("kind, expression, variables, line", ("standard", "order.total", "order,total", 4), ("spring", "cfg", "cfg", 4)))
def page_expressions(spark, sf):
    e = markup.extract_pages(_files(spark, sf, "jsp")).select(F.explode("el_expressions").alias("e"))
    return e.select("e.kind", "e.expression", F.array_join("e.variables", ",").alias("variables"), "e.line")


@query(_summed(_values("kind, k", ("jsp", 2), ("controller", 1), ("service", 1), ("mapper", 1), ("mapper_xml", 1)), "kind", total="sum(k)::BIGINT", completed="sum(k)::BIGINT", success_rate="100.0::DOUBLE"))
def batch_report(spark, sf):
    return batch.report(batch.analyse_files(_files(spark, sf)))["by_kind"]
