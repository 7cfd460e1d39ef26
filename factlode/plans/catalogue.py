"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from factlode.plans import answering, checks, evaluation, facts, pages, places, retrieval, sinks, structure, units

_MODULES = [units, facts, retrieval, pages, evaluation, structure, answering, places, checks, sinks]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = "p6_found"
