"""Queries on the supply and trade graphs: filters, traversals, metrics, merge, completeness, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, metrics, quality, render, traverse
from ..storage import materialize
from . import graphs
from .registry import query

SUP, TRADE, SECOND = (f"WITH RECURSIVE {x}" for x in (graphs.ORACLE_SUPPLY, graphs.ORACLE_TRADE, graphs.ORACLE_SECOND))
#: Weights and layers of the supply graph's types.
WEIGHTS = {"CUSTOMER": 5, "ORDER": 4, "PART": 3, "SUPPLIER": 2}
LAYERS = (("CUSTOMER",), ("ORDER",), ("PART",), ("SUPPLIER",), ("NATION",), ("REGION",))
WEIGHT_SQL = "CASE type WHEN 'CUSTOMER' THEN 5 WHEN 'ORDER' THEN 4 WHEN 'PART' THEN 3 WHEN 'SUPPLIER' THEN 2 ELSE 1 END"
SEVERITY_SQL = "CASE WHEN raw >= 75 THEN 'CRITICAL' WHEN raw >= 50 THEN 'HIGH' WHEN raw >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
RULES = (
    ("order_without_part", ("ORDER",), "successor", ("PART",), "high"),
    ("part_without_supplier", ("PART",), "successor", ("SUPPLIER",), "medium"),
    ("part_never_ordered", ("PART",), "predecessor", (), "low"),
    ("customer_without_order", ("CUSTOMER",), "relation", ("PLACES",), "low"),
)
MISSING_SQL = """
m AS (SELECT 'order_without_part' AS issue, 'high' AS severity, id AS node_id, type FROM nodes n WHERE type = 'ORDER' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id AND e.dst LIKE 'PART:%')
UNION ALL SELECT 'part_without_supplier', 'medium', id, type FROM nodes n WHERE type = 'PART' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id AND e.dst LIKE 'SUPPLIER:%')
UNION ALL SELECT 'part_never_ordered', 'low', id, type FROM nodes n WHERE type = 'PART' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id)
UNION ALL SELECT 'customer_without_order', 'low', id, type FROM nodes n WHERE type = 'CUSTOMER' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id AND e.relation = 'PLACES'))"""
DEG = "d AS (SELECT id AS node, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM edges WHERE src = id) AS out_degree FROM nodes)"


def _one(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"{SUP} SELECT coalesce(type, 'UNKNOWN') AS type, count(*) AS n FROM nodes GROUP BY 1")
def nodes_by_type(spark, sf):
    return graphs.supply(spark, sf).nodes.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("n"))


@query(f"{SUP} SELECT relation, count(*) AS n FROM edges GROUP BY 1")
def edges_by_relation(spark, sf):
    return graphs.supply(spark, sf).edges.groupBy("relation").agg(F.count("*").alias("n"))


@query(f"{SUP}, b AS (SELECT unnest(['high', 'medium', 'low']) AS band) SELECT band, (SELECT count(*) FROM edges WHERE CASE WHEN coalesce(confidence, 1) >= 0.9 THEN 'high' WHEN coalesce(confidence, 1) >= 0.7 THEN 'medium' ELSE 'low' END = band) AS edges FROM b")
def confidence_bands(spark, sf):
    return metrics.confidence_bands(graphs.supply(spark, sf).edges)


@query(f"{SUP} SELECT src, dst, relation, confidence, split_part(src, ':', 1) AS src_type, split_part(dst, ':', 1) AS dst_type FROM edges WHERE coalesce(confidence, 1) < 0.8")
def low_confidence_edges(spark, sf):
    return render.low_confidence(graphs.supply(spark, sf))


@query(f"{SUP} SELECT relation, count(*) AS edges, round(avg(confidence), 4) AS average_confidence FROM edges GROUP BY 1")
def edge_summary(spark, sf):
    return graphs.supply(spark, sf).edges.groupBy("relation").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 4).alias("average_confidence"))


@query(f"{SUP} SELECT count(*) AS nodes, count(DISTINCT type) AS types, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT relation) FROM edges) AS relations FROM nodes")
def graph_summary(spark, sf):
    g = graphs.supply(spark, sf)
    return g.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("type").alias("types")).crossJoin(g.edges.agg(F.count("*").alias("edges"), F.countDistinct("relation").alias("relations")))


@query(f"""{SUP} SELECT type, count(*) AS total, count(*) FILTER (ok) AS covered, round(avg(ok::INT), 2) AS ratio FROM (
 SELECT id, type, id IN (SELECT src FROM edges WHERE relation = CASE type WHEN 'CUSTOMER' THEN 'PLACES' WHEN 'ORDER' THEN 'CONTAINS' WHEN 'PART' THEN 'SUPPLIED_BY' ELSE 'LOCATED_IN' END) AS ok
 FROM nodes WHERE type IN ('CUSTOMER', 'ORDER', 'PART', 'SUPPLIER')) t GROUP BY type""")
def coverage_by_layer(spark, sf):
    g = graphs.supply(spark, sf)
    return metrics.coverage(g.nodes, g.edges, [("CUSTOMER", None), ("ORDER", "CONTAINS"), ("PART", "SUPPLIED_BY"), ("SUPPLIER", "LOCATED_IN")])


@query(f"{SUP}, o AS (SELECT src AS id, count(*) AS k FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS k FROM edges GROUP BY 1) SELECT n.id AS node, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM nodes n LEFT JOIN o ON n.id = o.id LEFT JOIN i ON n.id = i.id")
def degree_table(spark, sf):
    g = graphs.supply(spark, sf)
    return metrics.degrees(g.nodes, g.edges)


@query(f"{SUP}, o AS (SELECT DISTINCT src AS id FROM edges), i AS (SELECT DISTINCT dst AS id FROM edges) SELECT count(*) FILTER (o.id IS NULL AND i.id IS NULL) AS orphans, count(*) FILTER (o.id IS NOT NULL AND i.id IS NULL) AS sources, count(*) FILTER (o.id IS NULL AND i.id IS NOT NULL) AS sinks FROM nodes n LEFT JOIN o ON n.id = o.id LEFT JOIN i ON n.id = i.id")
def source_sink_orphan(spark, sf):
    g = graphs.supply(spark, sf)
    d = metrics.degrees(g.nodes, g.edges)
    return d.agg(*[F.count_if(F.expr(rule)).alias(name) for rule, name in (("degree = 0", "orphans"), ("in_degree = 0 and out_degree > 0", "sources"), ("out_degree = 0 and in_degree > 0", "sinks"))])


@query(f"{TRADE} SELECT count(*) AS n, (SELECT count(*) FROM edges) AS m, round((SELECT count(*) FROM edges) / (count(*) * (count(*) - 1.0)), 4) AS density FROM nodes")
def graph_density(spark, sf):
    g = graphs.trade(spark, sf)
    both = g.nodes.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m")))
    return both.select("n", "m", F.round(F.col("m") / (F.col("n") * (F.col("n") - 1)), 4).alias("density"))


@query(f"{SUP} SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_fan_in(spark, sf):
    return graphs.supply(spark, sf).edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(5)


@query(f"{SUP} SELECT src AS node, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_fan_out(spark, sf):
    return graphs.supply(spark, sf).edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(5)


@query(f"{SUP} SELECT n.id AS node, type, (SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE src = n.id) AS dependencies, (SELECT count(DISTINCT src) FROM edges WHERE dst = n.id) AS dependents FROM nodes n WHERE id = 'SUPPLIER:3'")
def node_info(spark, sf):
    g = graphs.supply(spark, sf)
    own = g.nodes.where("id = 'SUPPLIER:3'").select(F.col("id").alias("node"), "type")
    out = g.edges.where("src = 'SUPPLIER:3'").agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("dependencies"))
    return own.crossJoin(out).crossJoin(g.edges.where("dst = 'SUPPLIER:3'").agg(F.countDistinct("src").alias("dependents")))


@query(f"{SUP} SELECT id, type FROM nodes WHERE contains(lower(name), 'r#00000001')")
def find_nodes_by_pattern(spark, sf):
    return graphs.supply(spark, sf).nodes.where(F.contains(F.lower("name"), F.lit("R#00000001".lower()))).select("id", "type")


@query(f"{SUP} SELECT name FROM nodes WHERE type = 'SUPPLIER'")
def query_by_type(spark, sf):
    return graphs.supply(spark, sf).nodes.where("type = 'SUPPLIER'").select("name")


@query(f"{SUP} SELECT dst, relation, confidence FROM edges WHERE src = 'ORDER:1'")
def edges_from_node(spark, sf):
    return graphs.supply(spark, sf).edges.where("src = 'ORDER:1'").select("dst", "relation", "confidence")


@query(f"{SUP} SELECT src, relation, confidence FROM edges WHERE dst = 'SUPPLIER:1'")
def edges_to_node(spark, sf):
    return graphs.supply(spark, sf).edges.where("dst = 'SUPPLIER:1'").select("src", "relation", "confidence")


@query(f"""{SECOND}, b AS (SELECT * FROM second UNION ALL SELECT 'NATION:1', 'NATION:1', 'LOOP', 1.5)
SELECT 'self_loop' AS problem, src || '->' || dst AS subject FROM b WHERE src = dst UNION ALL SELECT 'confidence_out_of_range', src || '->' || dst FROM b WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT 'unknown_source', src || '->' || dst FROM b WHERE src NOT IN (SELECT id FROM second_nodes) UNION ALL SELECT 'unknown_target', src || '->' || dst FROM b WHERE dst NOT IN (SELECT id FROM second_nodes)""")
def validate_graph(spark, sf):
    g = graphs.second_opinion(spark, sf, graphs.trade(spark, sf))
    bad = spark.createDataFrame([("NATION:1", "NATION:1", "LOOP", 1.5)], "src string, dst string, relation string, confidence double")
    return quality.invalid(g.nodes, g.edges.select("src", "dst", "relation", "confidence").unionByName(bad))


PATHS = "p AS (SELECT src AS origin, dst AS node, [src, dst] AS path, 1 AS hops FROM edges {start} UNION ALL SELECT origin, dst, list_append(path, dst), hops + 1 FROM p JOIN edges ON node = src WHERE NOT list_contains(path, dst) AND hops < {most})"


@query(f"{TRADE}, {PATHS.format(start=chr(32) + 'WHERE src = ' + chr(39) + 'NATION:0' + chr(39), most=8)}, s AS (SELECT node, hops, path FROM p), b AS (SELECT node, min(hops) AS hops FROM s GROUP BY 1) SELECT s.node AS target, array_to_string(min(path), '->') AS path, s.hops::INT AS hops FROM s JOIN b ON s.node = b.node AND s.hops = b.hops WHERE s.node = (SELECT max(node) FROM b WHERE hops = (SELECT max(hops) FROM b)) GROUP BY s.node, s.hops")
def shortest_path(spark, sf):
    g = graphs.trade(spark, sf)
    far = traverse.bfs_levels(g.edges, _one(spark, "NATION:0")).orderBy(F.desc("level"), F.desc("node")).head()
    out = traverse.shortest_path(g.edges, "NATION:0", far["node"])
    return out.select(F.lit(far["node"]).alias("target"), F.array_join("path", "->").alias("path"), "hops")


@query(f"{TRADE}, {PATHS.format(start='', most=4)} SELECT array_to_string(path, '->') AS path, hops::INT AS hops FROM p")
def all_simple_paths(spark, sf):
    g = graphs.trade(spark, sf)
    return traverse.simple_paths(g.edges, g.nodes, 4).select(F.array_join("path", "->").alias("path"), "hops")


@query(f"{SUP}, p AS (SELECT ['CUSTOMER:1'] AS path, 'CUSTOMER:1' AS node UNION ALL SELECT list_append(path, dst), dst FROM p JOIN edges ON node = src WHERE NOT list_contains(path, dst) AND node <> 'NATION:1') SELECT array_to_string(path, '->') AS path, array_to_string(list_transform(path, lambda x: split_part(x, ':', 1)), '>') AS node_types, (len(path) - 1)::INT AS depth FROM p WHERE node = 'NATION:1' ORDER BY p.path LIMIT 100")
def call_chains(spark, sf):
    g = graphs.supply(spark, sf)
    near = traverse.bfs_levels(g.edges, _one(spark, "CUSTOMER:1")).select(F.col("node").alias("id"))
    g = g.subgraph(near)
    edges = materialize(g.edges, "chain-edges")
    out = traverse.call_chains(edges, g.nodes, "CUSTOMER:1", "NATION:1")
    return out.select(F.array_join("path", "->").alias("path"), F.array_join("node_types", ">").alias("node_types"), "depth")


@query(f"{SUP} SELECT src || '->' || dst AS path, string_agg(DISTINCT relation, ',') AS edge_types FROM edges WHERE src = 'PART:1' GROUP BY src, dst ORDER BY dst LIMIT 100")
def direct_dependencies(spark, sf):
    g = graphs.supply(spark, sf)
    own = g.edges.where("src = 'PART:1'")
    out = traverse.call_chains(own, g.nodes, "PART:1")
    return out.select(F.array_join("path", "->").alias("path"), F.array_join(F.flatten("edge_types"), ",").alias("edge_types"))


@query(f"{TRADE}, f AS (SELECT * FROM edges WHERE relation = 'PRIMARY'), r AS (SELECT id AS origin, id AS node FROM nodes UNION SELECT origin, dst FROM r JOIN f ON node = src) SELECT origin, count(*) - 1 AS reached FROM r GROUP BY 1")
def relation_filtered_path(spark, sf):
    g = graphs.trade(spark, sf).filter_relations(["PRIMARY"])
    return traverse.bfs_levels(g.edges, g.nodes).groupBy("origin").agg((F.count("*") - 1).alias("reached"))


@query(f"{TRADE}, p AS (SELECT src AS origin, dst AS node, [src, dst] AS path, 1 / confidence AS cost FROM edges UNION ALL SELECT origin, dst, list_append(path, dst), cost + 1 / confidence FROM p JOIN edges ON node = src WHERE NOT list_contains(path, dst) AND len(path) < 9) SELECT origin, node, round(min(cost), 4) AS cost FROM p WHERE origin IN ('NATION:0', 'NATION:7') GROUP BY 1, 2")
def weighted_shortest_path(spark, sf):
    g = graphs.trade(spark, sf)
    out = traverse.weighted_distances(g.edges, _one(spark, "NATION:0", "NATION:7"))
    return out.where("origin <> node").select("origin", "node", F.round("cost", 4).alias("cost"))


NEAR = "l AS (SELECT '{0}' AS node, 0 AS level UNION SELECT {1}, level + 1 FROM l JOIN edges ON {2} = node WHERE level < {3}), b AS (SELECT node, min(level) AS level FROM l GROUP BY 1), v AS (SELECT e.{1} AS node, b.level + 1 AS level, min((relation, e.{2}, confidence)) AS e FROM b JOIN edges e ON e.{2} = b.node GROUP BY 1, 2) SELECT '{0}' AS origin, b.node, type, (b.level - 1)::INT AS depth, v.e[1] AS relation, v.e[3] AS confidence FROM b JOIN v ON b.node = v.node AND b.level = v.level JOIN nodes ON id = b.node WHERE b.level > 0"


@query(f"{SUP}, {NEAR.format('SUPPLIER:1', 'src', 'dst', 3)}")
def dependencies_upstream(spark, sf):
    g = graphs.supply(spark, sf)
    return traverse.neighbours_with_depth(g.edges, g.nodes, _one(spark, "SUPPLIER:1"), "up", 3)


@query(f"{SUP}, {NEAR.format('CUSTOMER:1', 'dst', 'src', 3)}")
def dependents_downstream(spark, sf):
    g = graphs.supply(spark, sf)
    return traverse.neighbours_with_depth(g.edges, g.nodes, _one(spark, "CUSTOMER:1"), "down", 3)


@query(f"""{TRADE}, d AS (SELECT id AS origin, id AS node, 0 AS level FROM nodes UNION SELECT origin, dst, level + 1 FROM d JOIN edges ON node = src WHERE level < 5),
u AS (SELECT id AS origin, id AS node, 0 AS level FROM nodes UNION SELECT origin, src, level + 1 FROM u JOIN edges ON node = dst WHERE level < 5)
SELECT 'downstream' AS direction, origin, node, min(level)::INT AS level FROM d GROUP BY 2, 3 HAVING min(level) > 0 UNION ALL SELECT 'upstream', origin, node, min(level)::INT FROM u GROUP BY 2, 3 HAVING min(level) > 0""")
def impact_levels(spark, sf):
    g = graphs.trade(spark, sf)
    side = lambda name, way: traverse.bfs_levels(g.edges, g.nodes, way, 5).where("level > 0").select(F.lit(name).alias("direction"), "origin", "node", "level")
    return side("downstream", "down").unionByName(side("upstream", "up"))


@query(f"""{SUP}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), r AS (SELECT src AS origin, dst AS node FROM e UNION SELECT origin, dst FROM r JOIN e ON node = src),
s AS (SELECT origin, count(*) AS affected, sum({WEIGHT_SQL}) / (count(*) * 5.0) * 100 AS raw FROM r JOIN nodes ON id = node WHERE origin <> node GROUP BY 1)
SELECT n.id AS origin, coalesce(affected, 0) AS affected, round(coalesce(raw, 0), 2) AS score, {SEVERITY_SQL} AS severity FROM nodes n LEFT JOIN s ON n.id = s.origin""")
def impact_score(spark, sf):
    g = graphs.supply(spark, sf)
    return metrics.impact_of_all(g.nodes, g.edges, WEIGHTS)


@query(f"{SUP}, r AS (SELECT 'SUPPLIER:0' AS node UNION SELECT src FROM r JOIN edges ON node = dst) SELECT type, count(*) AS n FROM r JOIN nodes ON id = node WHERE node <> 'SUPPLIER:0' GROUP BY 1")
def impact_by_type(spark, sf):
    g = graphs.supply(spark, sf)
    reach = traverse.bfs_levels(g.edges, _one(spark, "SUPPLIER:0"), "up").where("level > 0")
    return reach.join(g.nodes, F.col("node") == F.col("id")).groupBy("type").agg(F.count("*").alias("n"))


@query(f"{SUP}, p AS (SELECT [id] AS path, id AS node FROM nodes WHERE id IN ('ORDER:5', 'ORDER:6') UNION ALL SELECT list_append(path, dst), dst FROM p JOIN edges ON node = src) SELECT array_to_string(path, '->') AS path, len(path)::INT AS length FROM p WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = node)")
def dependency_chain_by_layer(spark, sf):
    g = graphs.supply(spark, sf)
    out = traverse.dependency_chains(g.edges, g.nodes, _one(spark, "ORDER:5", "ORDER:6"), LAYERS)
    return out.select(F.array_join("path", "->").alias("path"), "length")


@query(f"{TRADE}, r AS (SELECT src AS origin, dst AS node FROM edges UNION SELECT origin, dst FROM r JOIN edges ON node = src) SELECT a.origin AS node, min(a.node) AS component FROM r a JOIN r b ON a.origin = b.node AND a.node = b.origin GROUP BY 1")
def cycles(spark, sf):
    return traverse.cycle_members(graphs.trade(spark, sf).edges)


@query(f"{TRADE}, e AS (SELECT DISTINCT src, dst FROM edges), p AS (SELECT src AS start, dst AS node, [src, dst] AS path FROM e WHERE dst >= src UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN e ON node = src WHERE node <> start AND len(path) <= 4 AND (dst = start OR dst > start AND NOT list_contains(path, dst))) SELECT array_to_string(path, '->') AS path, (len(path) - 1)::INT AS hops FROM p WHERE node = start")
def cycle_paths(spark, sf):
    return traverse.cycle_paths(graphs.trade(spark, sf).edges, 4).select(F.array_join("path", "->").alias("path"), "hops")


@query(f"{SUP}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), p AS (SELECT id AS node, 0 AS d FROM nodes WHERE id NOT IN (SELECT src FROM e) UNION SELECT src, d + 1 FROM p JOIN e ON dst = node) SELECT node, max(d)::INT AS depth FROM p GROUP BY 1")
def dag_depth(spark, sf):
    g = graphs.supply(spark, sf)
    return traverse.dag_depth(g.edges, g.nodes)


@query(f"{SUP}, b AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT 'REGION:0' AS node UNION SELECT dst FROM r JOIN b ON node = src), o AS (SELECT id FROM nodes WHERE id NOT IN (SELECT node FROM r)), q AS (SELECT id AS node, id AS label FROM o UNION SELECT b.dst, label FROM q JOIN b ON node = b.src) SELECT node, (SELECT min(node) FROM r) AS component FROM r UNION ALL SELECT node, min(label) FROM q GROUP BY 1")
def connected_components(spark, sf):
    g = graphs.supply(spark, sf)
    return traverse.components(g.edges, g.nodes)


SHORT = "q AS (SELECT id AS origin, id AS node, [id] AS path, 0 AS hops FROM nodes UNION ALL SELECT origin, dst, list_append(path, dst), hops + 1 FROM q JOIN edges ON node = src WHERE NOT list_contains(path, dst) AND hops < 7), best AS (SELECT origin, node, min(hops) AS hops FROM q GROUP BY 1, 2), sp AS (SELECT q.* FROM q JOIN best b ON q.origin = b.origin AND q.node = b.node AND q.hops = b.hops WHERE q.hops > 0), cnt AS (SELECT origin, node, count(*) AS k FROM sp GROUP BY 1, 2), thru AS (SELECT sp.origin, sp.node, unnest(sp.path[2:-2]) AS mid FROM sp), btw AS (SELECT mid, sum(1.0 / k) / ((SELECT (count(*) - 1) * (count(*) - 2) FROM nodes)) AS v FROM thru JOIN cnt ON thru.origin = cnt.origin AND thru.node = cnt.node GROUP BY 1), clo AS (SELECT node, count(*) * count(*) / ((SELECT count(*) - 1.0 FROM nodes) * sum(hops)) AS v FROM best WHERE hops > 0 GROUP BY 1)"


@query(f"{TRADE}, {SHORT} SELECT id AS node, round(coalesce(v, 0), 6) AS betweenness FROM nodes LEFT JOIN btw ON id = mid")
def betweenness(spark, sf):
    g = graphs.trade(spark, sf)
    return metrics.betweenness(g.edges, g.nodes).select("node", F.round("betweenness", 6).alias("betweenness"))


@query(f"{TRADE}, {SHORT} SELECT id AS node, round(coalesce(v, 0), 6) AS closeness FROM nodes LEFT JOIN clo ON id = node")
def closeness(spark, sf):
    g = graphs.trade(spark, sf)
    return metrics.closeness(g.edges, g.nodes).select("node", F.round("closeness", 6).alias("closeness"))


CRIT = f"{TRADE}, {SHORT}, {DEG}, imp AS (SELECT origin, round(sum(1) / (count(*) * 5.0) * 100, 2) AS v FROM best WHERE hops > 0 GROUP BY 1)"


@query(f"{CRIT} SELECT d.node, in_degree + out_degree AS degree, round(coalesce(btw.v, 0), 6) AS betweenness, coalesce(imp.v, 0) AS impact, round(0.3 * (in_degree + out_degree) + 30 * coalesce(btw.v, 0) + 0.4 * coalesce(imp.v, 0), 2) AS criticality FROM d LEFT JOIN btw ON d.node = mid LEFT JOIN imp ON d.node = imp.origin ORDER BY criticality DESC, d.node LIMIT 10")
def critical_nodes(spark, sf):
    g = graphs.trade(spark, sf)
    return metrics.critical_nodes(g.nodes, g.edges, 10, WEIGHTS).withColumn("betweenness", F.round("betweenness", 6))


@query(f"{CRIT} SELECT d.node, in_degree, out_degree, in_degree + out_degree AS degree, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM edges WHERE dst = d.node), '') AS predecessors, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE src = d.node), '') AS successors, round(coalesce(btw.v, 0), 4) AS betweenness, round(coalesce(clo.v, 0), 4) AS closeness FROM d LEFT JOIN btw ON d.node = mid LEFT JOIN clo ON d.node = clo.node")
def node_metrics(spark, sf):
    g = graphs.trade(spark, sf)
    return metrics.node_metrics(g.nodes, g.edges)


@query(f"{TRADE}, {DEG}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT id AS origin, id AS node FROM nodes UNION SELECT origin, dst FROM r JOIN b ON node = src), c AS (SELECT node, min(origin) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS k FROM c GROUP BY 1), m AS (SELECT count(*) AS m, count(DISTINCT relation) AS relations FROM edges) SELECT count(*) AS n, any_value(m.m) AS m, count(DISTINCT type) AS types, any_value(relations) AS relations, round(any_value(m.m) / (count(*) * (count(*) - 1.0)), 4) AS density, round(2.0 * any_value(m.m) / count(*), 2) AS average_degree, (SELECT max(in_degree + out_degree) FROM d) AS max_degree, (SELECT count(*) FROM d WHERE in_degree + out_degree = 0) AS orphans, (SELECT count(*) FROM d WHERE in_degree = 0 AND out_degree > 0) AS sources, (SELECT count(*) FROM d WHERE in_degree > 0 AND out_degree = 0) AS sinks, (SELECT count(*) FROM s) AS components, (SELECT max(k) FROM s) AS largest FROM nodes, m")
def graph_statistics(spark, sf):
    g = graphs.trade(spark, sf)
    return metrics.graph_statistics(g.nodes, g.edges)


@query(f"{SECOND} SELECT coalesce(n.id, s.id) AS id, coalesce(n.type, s.type) AS type, coalesce(n.name, s.name) AS name, CASE WHEN s.id IS NULL THEN 'code' WHEN n.id IS NULL THEN 'llm' ELSE 'code+llm' END AS source_type FROM nodes n FULL JOIN second_nodes s ON n.id = s.id")
def merge_nodes(spark, sf):
    g = graphs.trade(spark, sf)
    return merge.merge_nodes(g.nodes, graphs.second_opinion(spark, sf, g).nodes)


MERGE = f"""{SECOND}, rev AS (SELECT c.src, c.dst FROM edges c WHERE EXISTS (SELECT 1 FROM second s WHERE s.src = c.dst AND s.dst = c.src) AND NOT EXISTS (SELECT 1 FROM second s WHERE s.src = c.src AND s.dst = c.dst)),
s2 AS (SELECT * FROM second s WHERE NOT EXISTS (SELECT 1 FROM rev WHERE rev.src = s.dst AND rev.dst = s.src)),
a AS (SELECT coalesce(c.src, s.src) AS src, coalesce(c.dst, s.dst) AS dst, c.relation AS cr, s.relation AS sr, coalesce(c.confidence, 1) AS cc, coalesce(s.confidence, 0.7) AS sc, c.src IS NOT NULL AS c, s.src IS NOT NULL AS s FROM edges c FULL JOIN s2 s ON c.src = s.src AND c.dst = s.dst),
b AS (SELECT *, c AND s AND cr <> sr AS rel, c AND s AND round(abs(cc - sc), 10) > 0.3 AS conf FROM a),
m AS (SELECT src, dst, coalesce(cr, sr) AS relation, round(CASE WHEN NOT s THEN cc WHEN NOT c THEN sc * 0.9 WHEN conf THEN greatest(cc, sc) WHEN rel THEN cc ELSE least(greatest(cc, sc) + 0.1, 1.0) END, 6) AS confidence, CASE WHEN NOT s THEN 'code' WHEN NOT c THEN 'llm' ELSE 'code+llm' END AS source_type, rel OR conf AS had_conflicts FROM b),
k AS (SELECT src, dst, 'relation_mismatch' AS conflict, cr AS first_value, sr AS second_value FROM b WHERE rel UNION ALL SELECT src, dst, 'confidence_mismatch', round(cc, 2)::DOUBLE::VARCHAR, round(sc, 2)::DOUBLE::VARCHAR FROM b WHERE conf UNION ALL SELECT src, dst, 'direction_conflict', src || '->' || dst, dst || '->' || src FROM rev)"""


@query(f"{MERGE} SELECT * FROM m")
def merge_edges(spark, sf):
    g = graphs.trade(spark, sf)
    return merge.merge_edges(g.edges, graphs.second_opinion(spark, sf, g).edges)


@query(f"{MERGE} SELECT * FROM k")
def merge_conflicts(spark, sf):
    g = graphs.trade(spark, sf)
    return merge.conflicts(g.edges, graphs.second_opinion(spark, sf, g).edges)


@query(f"{MERGE} SELECT * FROM rev")
def direction_conflicts(spark, sf):
    g = graphs.trade(spark, sf)
    return merge.direction_conflicts(g.edges, graphs.second_opinion(spark, sf, g).edges)


@query(f"{MERGE} SELECT (SELECT count(*) FROM nodes n FULL JOIN second_nodes s ON n.id = s.id) AS total_nodes, count(*) AS total_edges, count(*) FILTER (NOT had_conflicts AND source_type = 'code+llm') AS edges_both, count(*) FILTER (NOT had_conflicts AND source_type = 'code') AS edges_code, count(*) FILTER (NOT had_conflicts AND source_type = 'llm') AS edges_llm, count(*) FILTER (had_conflicts) AS edges_with_conflicts, (SELECT count(*) FROM k WHERE conflict = 'relation_mismatch') AS relation_mismatch, (SELECT count(*) FROM k WHERE conflict = 'confidence_mismatch') AS confidence_mismatch, (SELECT count(*) FROM k WHERE conflict = 'direction_conflict') AS direction_conflict FROM m")
def merge_report(spark, sf):
    g = graphs.trade(spark, sf)
    return merge.merge_report(g, graphs.second_opinion(spark, sf, g))


ENDS = "ends AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"


@query(f"{SUP}, ends AS MATERIALIZED (SELECT src AS id FROM edges WHERE relation = 'CONTAINS' UNION SELECT dst FROM edges WHERE relation = 'CONTAINS') SELECT nodes.id, type, name FROM nodes LEFT JOIN ends ON nodes.id = ends.id WHERE ends.id IS NULL")
def orphan_nodes(spark, sf):
    g = graphs.supply(spark, sf).filter_relations(["CONTAINS"])
    return quality.orphans(g.nodes, g.edges)


@query(f"{SUP}, {MISSING_SQL} SELECT * FROM m")
def missing_relationships(spark, sf):
    g = graphs.supply(spark, sf)
    return quality.missing_relationships(g.nodes, g.edges, RULES)


@query(f"""{SUP}, {MISSING_SQL}, {ENDS}, o AS (SELECT nodes.id FROM nodes LEFT JOIN ends ON nodes.id = ends.id WHERE ends.id IS NULL),
c AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM o) AS orphans, (SELECT count(*) FROM m) AS issues)
SELECT *, round(greatest(0.0, least(0.5 * least(edges / 2.0 / nodes, 1.0) + 0.3 * (1 - orphans / nodes) + 0.2 * (1 - issues / nodes), 1.0)), 4) AS score FROM c""")
def completeness_score(spark, sf):
    g = graphs.supply(spark, sf)
    return quality.completeness(g.nodes, g.edges, RULES)


@query(f"{SUP}, o AS (SELECT src AS id, count(*) AS k FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(*) AS k FROM edges GROUP BY 1), d AS (SELECT n.*, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM nodes n LEFT JOIN o ON n.id = o.id LEFT JOIN i ON n.id = i.id) SELECT id AS node, type, 25 + least(5 * degree, 25) AS size, '#9E9E9E' AS colour, type || ' | ' || substr(coalesce(name, id), 1, 50) || ' | degree ' || degree AS tooltip FROM d")
def viz_nodes(spark, sf):
    g = graphs.supply(spark, sf)
    return render.viz_nodes(g.nodes, g.edges)


@query(f"{SUP} SELECT src, dst, relation, round(3 * confidence, 2) AS width, CASE WHEN confidence >= 0.9 THEN '#2E7D32' WHEN confidence >= 0.7 THEN '#F9A825' ELSE '#C62828' END AS colour FROM edges")
def viz_edges(spark, sf):
    return render.viz_edges(graphs.supply(spark, sf).edges)


@query(f"{TRADE}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, relation) AS k FROM edges) SELECT 'n' || substr(md5(id), 1, 12) || '[\"' || name || '\"]' AS line FROM nodes UNION ALL SELECT 'n' || substr(md5(src), 1, 12) || ' -->|' || relation || '| n' || substr(md5(dst), 1, 12) FROM r WHERE k <= 2")
def mermaid_lines(spark, sf):
    return render.mermaid_lines(graphs.trade(spark, sf))


@query(f"{SUP} SELECT src, dst, relation FROM edges WHERE split_part(src, ':', 1) IN ('SUPPLIER', 'NATION', 'REGION') AND split_part(dst, ':', 1) IN ('SUPPLIER', 'NATION', 'REGION')")
def subgraph_by_type(spark, sf):
    g = graphs.supply(spark, sf)
    return g.subgraph(g.nodes.where("type in ('SUPPLIER', 'NATION', 'REGION')").select("id")).edges.select("src", "dst", "relation")
