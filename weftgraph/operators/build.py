"""Building the typed graph from extracted records: unions of projections for nodes, joins for edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..model import Graph
from . import java, mapper
from . import procedures as calling

NODE = ["id", "type", "name", "path", "metadata"]
EDGE = ["src", "dst", "relation", "confidence", "source_type", "description"]


def _meta(**values: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values.values()]))


def _node(df: DataFrame, id_: Column, kind: str, name: Column, path: Column, **meta: Column) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(kind).alias("type"), name.alias("name"), path.alias("path"), _meta(kind=F.lit(kind), **meta).alias("metadata"))


def class_id() -> Column:
    return F.concat_ws(".", F.nullif("package", F.lit("")), "class_name")


def jsp_nodes(pages: DataFrame) -> DataFrame:
    path = F.translate("path", "\\", "/")
    return _node(pages, F.concat(F.lit("JSP:"), path), "JSP", F.element_at(F.split(path, "/"), -1), path, forms=F.size("forms"), ajax_calls=F.size("ajax_calls"), includes=F.size("includes"))


def controller_nodes(classes: DataFrame) -> DataFrame:
    """Class nodes and method nodes; overloads share a node."""
    c = classes.where(java.has_annotation(F.col("class_annotations"), "Controller", "RestController"))
    ends = java.controllers(classes)
    one = _node(c, F.concat(F.lit("CONTROLLER:"), class_id()), "CONTROLLER", F.col("class_name"), F.col("path"), methods=F.size("methods"))
    many = _node(ends, F.concat(F.lit("CONTROLLER_METHOD:"), class_id(), F.lit("."), F.col("method")), "CONTROLLER_METHOD", F.concat("class_name", F.lit("."), "method"), F.col("path"), http_method=F.col("http_method"), url_path=F.col("url_path"), return_type=F.col("return_type"))
    return one.unionByName(many)


def service_nodes(classes: DataFrame) -> DataFrame:
    c = classes.where(java.has_annotation(F.col("class_annotations"), "Service", "Component"))
    s = java.services(classes)
    one = _node(c, F.concat(F.lit("SERVICE:"), class_id()), "SERVICE", F.col("class_name"), F.col("path"), methods=F.size("methods"))
    many = _node(s, F.concat(F.lit("SERVICE_METHOD:"), class_id(), F.lit("."), F.col("method")), "SERVICE_METHOD", F.concat("class_name", F.lit("."), "method"), F.col("path"), is_transactional=F.col("transactional.enabled"))
    return one.unionByName(many)


def mapper_nodes(interfaces: DataFrame, mappers: DataFrame) -> DataFrame:
    """Mapper and method nodes, keyed by namespace; interface methods count even without a statement."""
    own = interfaces.where(java.has_annotation(F.col("class_annotations"), "Mapper", "Repository"))
    names = mappers.select("namespace", "path").unionByName(own.select(class_id().alias("namespace"), "path"))
    one = _node(names, F.concat(F.lit("MAPPER:"), "namespace"), "MAPPER", F.element_at(F.split("namespace", "[.]"), -1), F.col("path"))
    methods = own.select(class_id().alias("namespace"), "path", F.explode("methods.name").alias("method"))
    many = _node(methods, F.concat(F.lit("MAPPER_METHOD:"), "namespace", F.lit("."), "method"), "MAPPER_METHOD", F.col("method"), F.col("path"))
    return one.unionByName(many)


def sql_nodes(mappers: DataFrame) -> DataFrame:
    s = mapper.statements(mappers)
    return _node(s, F.concat(F.lit("SQL:"), "namespace", F.lit("."), "id"), "SQL_STATEMENT", F.concat("id", F.lit(" ("), "type", F.lit(")")), F.lit(""), sql_type=F.col("type"), preview=F.substring("sql", 1, config.SQL_PREVIEW), is_callable=F.col("is_callable"), procedure_name=F.col("procedure_name"))


def database_nodes(tables: DataFrame, views: DataFrame, procedures: DataFrame) -> DataFrame:
    """Nodes of dictionary rows (``name``), keyed in upper case."""
    of = lambda df, kind: _node(df, F.concat(F.lit(kind + ":"), F.upper("name")), kind, F.col("name"), F.lit(""))
    return of(tables, "TABLE").unionByName(of(views, "VIEW")).unionByName(of(procedures, "PROCEDURE"))


def trigger_nodes(callers: DataFrame) -> DataFrame:
    return _node(callers.select("trigger_name").distinct(), F.concat(F.lit("TRIGGER:"), F.upper("trigger_name")), "TRIGGER", F.col("trigger_name"), F.lit(""))


def job_nodes(callers: DataFrame) -> DataFrame:
    """Job nodes; a job that any caller row has enabled is enabled."""
    per = callers.groupBy("job_name").agg(F.max("enabled").alias("enabled"))
    return _node(per, F.concat(F.lit("ORACLE_JOB:"), F.upper("job_name")), "ORACLE_JOB", F.col("job_name"), F.lit(""), enabled=F.col("enabled"))


def first_wins(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in the given order; of rows with equal keys the first part's stays, ties by ``order``."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(*keys).orderBy("_rank", *order)
    return ranked.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_rank")


def _edge(df: DataFrame, src: Column, dst: Column, relation: str, confidence: Column, description: Column) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), confidence.cast("double").alias("confidence"), F.lit("code").alias("source_type"), description.alias("description"))


def call_edges(classes: DataFrame, relation: str, src_kind: str, dst_kind: str, callers: DataFrame, calls: str, nodes: DataFrame) -> DataFrame:
    """Calls on injected fields, resolved to methods of the field's class: by full name first, else by simple class name; the least node on ties."""
    deps = classes.select("path", F.explode("dependencies").alias("d")).select("path", F.col("d.name").alias("receiver"), F.regexp_replace("d.type", "<.*", "").alias("type"))
    c = callers.select("path", class_id().alias("cls"), "method", F.explode(calls).alias("c")).select("path", "cls", "method", F.col("c.receiver").alias("receiver"), F.col("c.method").alias("called"))
    c = c.join(deps, ["path", "receiver"])
    simple = F.regexp_replace(F.element_at(F.split("type", "[.]"), -1), "^I(?=[A-Z])", "")
    target = nodes.where(F.col("type") == dst_kind).select("id", F.regexp_extract("id", r"([^.:]+)[.]([^.]+)$", 1).alias("to_class"), F.regexp_extract("id", r"([^.:]+)[.]([^.]+)$", 2).alias("called"))
    target = target.withColumn("to_class", F.regexp_replace("to_class", "Impl$", ""))
    hit = c.withColumn("to_class", F.regexp_replace(simple, "Impl$", "")).join(target, ["to_class", "called"])
    exact = F.col("id") == F.concat(F.lit(dst_kind + ":"), "type", F.lit("."), "called")
    w = Window.partitionBy("cls", "method", "receiver", "called").orderBy(exact.desc(), "id")
    hit = hit.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return _edge(hit, F.concat(F.lit(src_kind + ":"), "cls", F.lit("."), "method"), F.col("id"), relation, F.lit(1.0), F.concat("receiver", F.lit("."), "called"))


def mapper_to_sql(interfaces: DataFrame, mappers: DataFrame) -> DataFrame:
    m = mapper.method_mapping(interfaces, mappers)
    return _edge(m, F.concat(F.lit("MAPPER_METHOD:"), "namespace", F.lit("."), "method"), F.concat(F.lit("SQL:"), "namespace", F.lit("."), "statement_id"), "EXECUTES", F.lit(1.0), F.col("statement_id"))


def sql_to_tables(mappers: DataFrame) -> list[DataFrame]:
    s = mapper.statements(mappers).withColumn("t", F.explode("tables"))
    src, dst = F.concat(F.lit("SQL:"), "namespace", F.lit("."), "id"), F.concat(F.lit("TABLE:"), F.upper("t"))
    return [_edge(s.where("type = 'SELECT'"), src, dst, "QUERIES", F.lit(1.0), F.col("t")), _edge(s.where("type <> 'SELECT'"), src, dst, "MODIFIES", F.lit(1.0), F.col("t"))]


def sql_to_procedures(mappers: DataFrame) -> DataFrame:
    s = mapper.statements(mappers).where("is_callable and procedure_name is not null")
    return _edge(s, F.concat(F.lit("SQL:"), "namespace", F.lit("."), "id"), F.concat(F.lit("PROCEDURE:"), F.upper("procedure_name")), "CALLS_PROCEDURE", F.lit(1.0), F.substring("sql", 1, config.EDGE_SQL))


def include_edges(pages: DataFrame) -> DataFrame:
    i = pages.select("path", F.explode("includes").alias("i"))
    return _edge(i, F.concat(F.lit("JSP:"), "path"), F.concat(F.lit("JSP:"), "i.resolved_path"), "INCLUDES", F.lit(1.0), F.col("i.kind"))


def ajax_edges(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """CALLS from pages to controller methods, with the confidence of the URL match."""
    from . import urls

    calls = pages.select("path", F.posexplode("ajax_calls").alias("k", "c")).select(F.concat_ws("#", "path", F.col("k").cast("string")).alias("call_id"), F.col("c.url").alias("url"), F.col("c.method").alias("method"), "path")
    ends = java.controllers(classes).select(F.concat(F.lit("CONTROLLER_METHOD:"), class_id(), F.lit("."), F.col("method")).alias("endpoint_id"), F.col("url_path").alias("template"), F.array("http_method").alias("methods"))
    hit = urls.match(calls, ends).where("endpoint_id is not null").join(calls.select("call_id", "path"), "call_id")
    return _edge(hit, F.concat(F.lit("JSP:"), "path"), F.col("endpoint_id"), "CALLS", F.col("confidence"), F.col("url"))


def trigger_edges(callers: DataFrame) -> DataFrame:
    return _edge(callers, F.concat(F.lit("PROCEDURE:"), F.upper("procedure")), F.concat(F.lit("TRIGGER:"), F.upper("trigger_name")), "TRIGGERED_BY", F.lit(0.9), F.col("trigger_name"))


def job_edges(callers: DataFrame) -> DataFrame:
    return _edge(callers, F.concat(F.lit("PROCEDURE:"), F.upper("procedure")), F.concat(F.lit("ORACLE_JOB:"), F.upper("job_name")), "SCHEDULED_BY", F.lit(1.0), F.col("job_name"))


def declare_edges(nodes: DataFrame) -> DataFrame:
    """Optional DECLARES edges from class nodes to their method nodes."""
    m = nodes.where(F.col("type").endswith("_METHOD")).select("id", F.regexp_replace("id", r"_METHOD:(.*)[.][^.]+$", ":$1").alias("src"))
    m = m.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return _edge(m, F.col("src"), F.col("id"), "DECLARES", F.lit(1.0), F.lit(""))


def build_graph(pages: DataFrame, classes: DataFrame, mappers: DataFrame, tables: DataFrame, views: DataFrame, procedures: DataFrame, declares: bool = False, triggers: DataFrame | None = None, jobs: DataFrame | None = None) -> Graph:
    """The whole graph; edges whose ends are not nodes go, nodes and edges are distinct with the first in order winning.

    ``triggers`` (trigger_name, description) and ``jobs`` (job_name, job_type,
    job_action, enabled, broken) that call a procedure are nodes, with
    TRIGGERED_BY and SCHEDULED_BY edges from it.
    """
    kinds = [jsp_nodes(pages), controller_nodes(classes), service_nodes(classes), mapper_nodes(classes, mappers), sql_nodes(mappers), database_nodes(tables, views, procedures)]
    called = []
    if triggers is not None:
        by_trigger = calling.trigger_callers(procedures, triggers)
        kinds.append(trigger_nodes(by_trigger))
        called.append(trigger_edges(by_trigger))
    if jobs is not None:
        by_job = calling.job_callers(procedures, jobs)
        kinds.append(job_nodes(by_job))
        called.append(job_edges(by_job))
    nodes = first_wins(kinds, ["id"], ["path", "name"])
    ends, svc = java.controllers(classes), java.services(classes)
    parts = [
        include_edges(pages),
        call_edges(classes, "INVOKES", "CONTROLLER_METHOD", "SERVICE_METHOD", ends, "calls", nodes),
        call_edges(classes, "USES", "SERVICE_METHOD", "MAPPER_METHOD", svc, "mapper_calls", nodes),
        mapper_to_sql(classes, mappers), *sql_to_tables(mappers), sql_to_procedures(mappers), ajax_edges(pages, classes), *called,
    ]
    if declares:
        parts.append(declare_edges(nodes))
    edges = first_wins(parts, ["src", "dst", "relation"], ["description"])
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes.select(*NODE), edges.select(*EDGE))


def dependencies_of(results: DataFrame) -> DataFrame:
    """``results`` with ``dependencies array<string>`` from a list or the keys of a map, and from ``fields`` (type, annotations) that are injected.

    ``dependencies`` may be an array of strings or a map by name; ``fields`` may
    be missing.
    """
    kind = results.schema["dependencies"].dataType.simpleString()
    own = F.map_keys("dependencies") if kind.startswith("map") else F.col("dependencies")
    own = F.coalesce(own, F.array().cast("array<string>"))
    if "fields" in results.columns:
        injected = F.filter("fields", lambda f: F.exists(f["annotations"], lambda a: a.rlike("Autowired|Inject|Resource")) & (F.coalesce(f["type"], F.lit("")) != ""))
        own = F.concat(own, F.coalesce(F.transform(injected, lambda f: f["type"]), F.array().cast("array<string>")))
    return results.withColumn("dependencies", own)


def adjacency(graph: Graph) -> DataFrame:
    """``name, type, dependencies, dependents``: each node with its sorted neighbours, the rows of the graph's JSON."""
    near = lambda a, b, name: graph.edges.groupBy(F.col(a).alias("id")).agg(F.sort_array(F.collect_set(b)).alias(name))
    out = graph.nodes.select("id", "type").join(near("src", "dst", "dependencies"), "id", "left").join(near("dst", "src", "dependents"), "id", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias("name"), "type", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def component_graph(results: DataFrame) -> Graph:
    """The coarse graph of file-level results (name, kind, dependencies array<string>, view_names array<string>).

    ``uses`` from controllers to services and services to mappers by the last
    part of the dependency's name, ``renders`` from controllers to pages.
    """
    nodes = results.where("name is not null").select(F.col("name").alias("id"), F.col("kind").alias("type"), "name").dropDuplicates(["id"])
    last = dependencies_of(results).select("name", "kind", F.explode("dependencies").alias("d")).withColumn("dst", F.element_at(F.split("d", "[.]"), -1))
    rule = ((F.col("kind") == "controller") & F.col("dst").rlike("(?:Service|ServiceImpl)$")) | ((F.col("kind") == "service") & F.col("dst").endswith("Mapper"))
    uses = last.where(rule).select(F.col("name").alias("src"), "dst", F.lit("uses").alias("relation"))
    renders = results.where("kind = 'controller'").select(F.col("name").alias("src"), F.explode("view_names").alias("dst"), F.lit("renders").alias("relation"))
    edges = uses.unionByName(renders).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation").withColumn("confidence", F.lit(1.0))
    return Graph(nodes, edges)


