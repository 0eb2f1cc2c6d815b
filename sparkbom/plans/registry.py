"""All queries of the core."""

from __future__ import annotations

import importlib

from sparkbom.session import shipped

#: Modules with QUERIES (name -> callable) and SQL (name -> oracle).
MODULES = [f"sparkbom.plans.{m}" for m in ("problems", "graph_queries", "match_queries", "document_queries", "view_queries")]


def queries() -> dict:
    return {k: shipped(f) for m in MODULES for k, f in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(m).SQL.items()}
