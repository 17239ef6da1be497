"""Incremental updates: changed files replace what their old versions gave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph


def replace_changed(before: Graph, changed: DataFrame, after: Graph) -> Graph:
    """Nodes whose ``path`` is in ``changed`` (path) and the edges that touch them give way to those of ``after``."""
    paths = changed.select("path").distinct()
    gone = before.nodes.join(paths, "path", "left_semi").select("id")
    nodes = before.nodes.join(gone, "id", "left_anti").unionByName(after.nodes, allowMissingColumns=True).dropDuplicates(["id"])
    kept = before.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    edges = kept.unionByName(after.edges, allowMissingColumns=True).dropDuplicates(["src", "dst", "relation"])
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(nodes, edges)


def watch_sources(spark: SparkSession, folder: str, pattern: str, each: Callable[[DataFrame, int], None]):
    """A stream of new files in ``folder`` (path, content); ``each`` gets every batch once, by its number."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", "modificationTime", "length", F.decode("content", "UTF-8").alias("content"))
    return rows.writeStream.foreachBatch(each)
