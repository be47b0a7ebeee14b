"""All registered queries of the governed-data operators: name -> (query, SQL that gives the same rows)."""

from __future__ import annotations

from . import governance_queries, quality_queries, scalar_queries, source_queries, table_queries  # noqa: F401
from .base import ORACLES, QUERIES, Query, checkpoint_folder, query, table  # noqa: F401

FLAGSHIP = "flagship"
