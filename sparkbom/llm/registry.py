"""All queries of this subpackage. Its modules are imported here at once, so that a missing package keeps all of it out and nothing else."""

from __future__ import annotations

from sparkbom.llm import queries_leakage, queries_mixing, queries_origin, queries_secrets, queries_spam, queries_syntax
from sparkbom.session import shipped

MODULES = (queries_syntax, queries_spam, queries_leakage, queries_origin, queries_secrets, queries_mixing)


def queries() -> dict:
    return {k: shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
