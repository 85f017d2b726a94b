"""All queries of the ledger part by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import layout_queries, ledger_queries, more_queries, parser_queries, solver_queries, stream_queries

MODULES = (solver_queries, parser_queries, layout_queries, ledger_queries, stream_queries, more_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
