"""The query catalogue: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from tessera.plans import fact_queries, file_queries, graph_queries, state_queries, syntax_queries, text_queries, vector_queries  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
