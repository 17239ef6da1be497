"""A property graph as a pair of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``nodes(id, type, name, ...)`` and ``edges(src, dst, relation, confidence, ...)``."""

    nodes: DataFrame
    edges: DataFrame

    def filter_relations(self, relations: list[str] | None) -> Graph:
        """Keep edges of ``relations``; before a traversal, since filters do not move into loops."""
        return self if relations is None else Graph(self.nodes, self.edges.where(F.col("relation").isin(list(relations))))

    def subgraph(self, keep: DataFrame) -> Graph:
        """Nodes in ``keep`` (id) and the edges with both ends among them."""
        ids = keep.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), edges)

    def cached(self) -> Graph:
        return Graph(self.nodes.persist(), self.edges.persist())
