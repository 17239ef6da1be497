"""Analysis results and graphs as JSON or Parquet snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..model import Graph
from ..storage import materialize


def read_json_records(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of the ``*.json`` files in ``folder`` (names that start with ``_`` apart) with ``source_file``, and the files that do not parse."""
    full = f"{schema}, _corrupt string"
    raw = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "[!_]*.json").json(folder)
    raw = materialize(raw.withColumn("source_file", F.col("_metadata.file_name")), "records")  # Spark refuses to filter unread records on their errors
    return raw.where("_corrupt is null").drop("_corrupt"), raw.where("_corrupt is not null").select("source_file")


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph document: ``nodes`` and ``edges`` as lists, or as maps by id; a missing edge type is ``uses``."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    item = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")
    listed = lambda key: text.select(F.explode(F.try_variant_get("v", f"$.{key}", "array<variant>")).alias("x"))
    mapped = lambda key: text.select(F.explode(F.try_variant_get("v", f"$.{key}", "map<string, variant>")).alias("key", "x"))
    name = lambda key: F.coalesce(item("x", "id"), item("x", "name"), key)
    node = lambda df, key: df.select(name(key).alias("id"), F.coalesce(item("x", "type"), F.lit("UNKNOWN")).alias("type"), F.coalesce(item("x", "name"), name(key)).alias("name"))
    none = F.lit(None).cast("string")
    nodes = node(listed("nodes"), none).unionByName(node(mapped("nodes"), F.col("key")))
    edges = listed("edges").unionByName(mapped("edges").select("x"))
    edges = edges.select(F.coalesce(item("x", "source"), item("x", "from"), item("x", "src")).alias("src"), F.coalesce(item("x", "target"), item("x", "to"), item("x", "dst")).alias("dst"), F.coalesce(item("x", "relation"), item("x", "type"), F.lit("uses")).alias("relation"), F.coalesce(F.try_variant_get("x", "$.confidence", "double"), F.lit(1.0)).alias("confidence"))
    return Graph(nodes.where("id is not null"), edges.where("src is not null and dst is not null"))


def save_graph(graph: Graph, folder: str) -> None:
    """One snapshot format: Parquet tables of nodes and edges with the time of saving."""
    graph.nodes.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str, now: Column | None = None, hours: int = config.GRAPH_TTL_HOURS) -> Graph | None:
    """The snapshot, or None if it is older than ``hours``."""
    nodes, edges = (spark.read.parquet(f"{folder}/{k}") for k in ("nodes", "edges"))
    old = nodes.where(F.col("saved_at") < (now if now is not None else F.current_timestamp()) - F.make_dt_interval(hours=F.lit(hours)))
    return None if not old.isEmpty() else Graph(nodes.drop("saved_at"), edges.drop("saved_at"))


def latest(files: DataFrame) -> DataFrame:
    """The path of the newest graph file among ``files`` (path, mtime), statistics and low-confidence files apart."""
    return files.where(~F.col("path").rlike(r"(?:_stats|_low_confidence)[.]json$")).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def load_analyses(spark: SparkSession, folder: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Records of each kind in ``folder/kind`` and the files that do not parse; a missing folder is an empty table."""
    from pyspark.errors import AnalysisException

    out, bad = {}, spark.createDataFrame([], "kind string, source_file string")
    for kind, schema in schemas.items():
        try:
            out[kind], errors = read_json_records(spark, f"{folder}/{kind}", schema)
            bad = bad.unionByName(errors.select(F.lit(kind).alias("kind"), "source_file"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[kind] = spark.createDataFrame([], f"{schema}, source_file string")
    return out, bad


def analysis_summary(records: dict[str, DataFrame], nested: dict[str, str]) -> DataFrame:
    """``kind, records, items``: records of each kind and the total length of the array column that ``nested`` names."""
    out = None
    for kind, df in records.items():
        items = F.coalesce(F.sum(F.size(nested[kind])), F.lit(0)) if kind in nested else F.lit(0)
        one = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("records"), items.cast("long").alias("items"))
        out = one if out is None else out.unionByName(one)
    return out


def find_record(df: DataFrame, column: str, value: str) -> DataFrame:
    """The first record, by file, whose ``column`` is ``value``."""
    return df.where(F.col(column) == value).orderBy("source_file").limit(1)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_or_build(spark: SparkSession, folder: str, build: Callable[[], Graph], cache: str | None = None, hours: int = config.GRAPH_TTL_HOURS) -> tuple[Graph, str]:
    """The graph and where it came from: ``dependency_graph.json`` in ``folder``, else a fresh snapshot in ``cache``, else ``build``, whose result is saved there."""
    document, cache = f"{folder.rstrip('/')}/dependency_graph.json", cache or f"{folder.rstrip('/')}/.weftgraph"
    if _exists(spark, document):
        return read_graph_json(spark, document), "json"
    if _exists(spark, f"{cache}/nodes") and (graph := load_graph(spark, cache, hours=hours)) is not None:
        return graph, "cache"
    save_graph(build(), cache)
    return Graph(*(spark.read.parquet(f"{cache}/{k}").drop("saved_at") for k in ("nodes", "edges"))), "built"


def latest_graph(spark: SparkSession, folder: str) -> Graph | None:
    """The newest graph document in ``folder``, statistics and low-confidence files apart; None if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("modificationTime").alias("mtime"))
    found = latest(files).head()["path"]
    return read_graph_json(spark, found) if found else None


def read_optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame | None, list[str]]:
    """One JSON document that may be missing, as a table of one row, and what is wrong with it."""
    if not _exists(spark, path):
        return None, []
    got = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    got = materialize(got, "document")
    return (None, [f"{path} is not JSON"]) if got.where("_corrupt is not null").count() else (got.drop("_corrupt"), [])


def listing(records: DataFrame, **defaults: object) -> DataFrame:
    """The named fields of each record, with ``defaults`` where a record or the whole table lacks them."""
    return records.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) if k in records.columns else F.lit(v).alias(k) for k, v in defaults.items()])


def cache_write(spark: SparkSession, results: DataFrame, folder: str) -> None:
    """Append analysis results (path, fingerprint, ..) with the time of caching."""
    results.withColumn("cached_at", F.current_timestamp()).write.mode("append").parquet(folder)


def cache_statistics(cache: DataFrame) -> DataFrame:
    """One row: ``entries, files, oldest, newest`` of a result cache."""
    return cache.agg(F.count("*").alias("entries"), F.countDistinct("path").alias("files"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))
