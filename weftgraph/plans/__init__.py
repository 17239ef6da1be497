"""Ready-made plans: graphs over the star-schema tables and the queries on them."""

from . import extract_queries as _extract_queries
from . import graph_queries as _graph_queries
from . import text_queries as _text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
