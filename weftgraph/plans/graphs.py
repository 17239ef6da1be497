"""Graphs derived from the star-schema tables, as one SQL text that Spark and the oracle both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Graph
from ..storage import kept

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

SUPPLY_NODES = """
SELECT 'CUSTOMER:' || c_custkey AS id, 'CUSTOMER' AS type, c_name AS name FROM {customer}
UNION ALL SELECT 'ORDER:' || o_orderkey, 'ORDER', 'order ' || o_orderkey FROM {orders}
UNION ALL SELECT 'PART:' || p_partkey, 'PART', p_name FROM {part}
UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'SUPPLIER', s_name FROM {supplier}
UNION ALL SELECT 'NATION:' || n_nationkey, 'NATION', n_name FROM {nation}
UNION ALL SELECT 'REGION:' || r_regionkey, 'REGION', r_name FROM {region}
"""
SUPPLY_EDGES = """
SELECT 'CUSTOMER:' || o_custkey AS src, 'ORDER:' || o_orderkey AS dst, 'PLACES' AS relation, CAST(1.0 AS DOUBLE) AS confidence FROM {orders}
UNION ALL SELECT 'ORDER:' || l_orderkey, 'PART:' || l_partkey, 'CONTAINS', round(1 - 5 * max(l_discount), 2) FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT DISTINCT 'PART:' || l_partkey, 'SUPPLIER:' || l_suppkey, 'SUPPLIED_BY', CAST(1.0 AS DOUBLE) FROM {lineitem}
UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'NATION:' || s_nationkey, 'LOCATED_IN', CAST(1.0 AS DOUBLE) FROM {supplier}
UNION ALL SELECT 'NATION:' || n_nationkey, 'REGION:' || n_regionkey, 'PART_OF', CAST(1.0 AS DOUBLE) FROM {nation}
"""
TRADE_NODES = "SELECT 'NATION:' || n_nationkey AS id, 'NATION' AS type, n_name AS name FROM {nation}"
TRADE_EDGES = """
SELECT 'NATION:' || buyer AS src, 'NATION:' || seller AS dst, CASE WHEN rn = 1 THEN 'PRIMARY' ELSE 'SECONDARY' END AS relation, round(1.0 - 0.15 * rn, 2) AS confidence
FROM (SELECT buyer, seller, row_number() OVER (PARTITION BY buyer ORDER BY revenue DESC, seller) AS rn
      FROM (SELECT c_nationkey AS buyer, s_nationkey AS seller, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
            FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
            WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) AS r) AS t
WHERE rn <= 3
"""
#: A second opinion on the trade graph, by nation numbers: some edges missing, turned, renamed or doubted, some new.
SECOND_EDGES = """
SELECT CASE WHEN h = 1 THEN dst ELSE src END AS src, CASE WHEN h = 1 THEN src ELSE dst END AS dst,
       CASE WHEN h = 2 THEN 'ALLEGED' ELSE relation END AS relation, CASE WHEN h = 3 THEN round(confidence - 0.4, 2) ELSE confidence END AS confidence
FROM (SELECT *, (CAST(substr(src, 8) AS INT) * 31 + CAST(substr(dst, 8) AS INT)) % 5 AS h FROM {edges}) AS p WHERE h <> 0
UNION ALL SELECT 'NATION:' || n_nationkey, 'NATION:' || n_regionkey, 'GUESSED', CAST(0.8 AS DOUBLE) FROM {nation} WHERE n_nationkey >= 20
"""


def tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in (names or TABLES)}


def _sql(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(text, **{n: f for n, f in frames.items() if "{" + n + "}" in text})


def _sources(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{n}.parquet" for n in "region nation customer supplier part orders lineitem".split()]


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to regions over orders, parts and suppliers; written once a session, since queries and rounds read it often."""
    t = tables(spark, sf_dir)
    nodes = kept(spark, "supply-nodes", _sources(sf_dir), lambda: _sql(spark, SUPPLY_NODES, t))
    return Graph(nodes, kept(spark, "supply-edges", _sources(sf_dir), lambda: _sql(spark, SUPPLY_EDGES, t).sortWithinPartitions("src")))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """The cyclic graph of 25 nations; written once a session."""
    t = tables(spark, sf_dir)
    nodes = kept(spark, "trade-nodes", _sources(sf_dir), lambda: _sql(spark, TRADE_NODES, t))
    return Graph(nodes, kept(spark, "trade-edges", _sources(sf_dir), lambda: _sql(spark, TRADE_EDGES, t).coalesce(1)))


def second_opinion(spark: SparkSession, sf_dir: str, first: Graph) -> Graph:
    t = tables(spark, sf_dir, ["nation"])
    edges = _sql(spark, SECOND_EDGES, {"edges": first.edges, **t}).groupBy("src", "dst").agg({"relation": "min", "confidence": "max"})
    edges = edges.withColumnsRenamed({"min(relation)": "relation", "max(confidence)": "confidence"})
    extra = spark.sql("SELECT 'NATION:' || (n_nationkey + 100) AS id, 'NATION' AS type, 'new ' || n_name AS name FROM {nation} WHERE n_nationkey < 3", **t)
    return Graph(first.nodes.where("id <> 'NATION:0'").unionByName(extra), edges)


def _named(text: str, **more: str) -> str:
    return text.format(**{n: n for n in TABLES}, **more)


ORACLE_SUPPLY = f"nodes AS MATERIALIZED ({_named(SUPPLY_NODES)}), edges AS MATERIALIZED ({_named(SUPPLY_EDGES)})"
ORACLE_TRADE = f"nodes AS ({_named(TRADE_NODES)}), edges AS MATERIALIZED ({_named(TRADE_EDGES)})"
ORACLE_SECOND = (
    ORACLE_TRADE
    + f", second AS MATERIALIZED (SELECT src, dst, min(relation) AS relation, max(confidence) AS confidence FROM ({_named(SECOND_EDGES, edges='edges')}) AS x GROUP BY src, dst)"
    + ", second_nodes AS (SELECT * FROM nodes WHERE id <> 'NATION:0' UNION ALL SELECT 'NATION:' || (n_nationkey + 100), 'NATION', 'new ' || n_name FROM nation WHERE n_nationkey < 3)"
)
