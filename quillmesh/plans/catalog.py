"""All queries of the core and their SQL equivalents."""

from __future__ import annotations

from quillmesh.plans import changes, dialogue, library, notes, search

MODULES = (changes, notes, search, library, dialogue)
FLAGSHIP = "hybrid_search"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
