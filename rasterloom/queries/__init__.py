"""The library's queries over the bindings, and the same in DuckDB SQL."""

from __future__ import annotations

from rasterloom.queries import colour, edits, finishing, metrics, misc, regions, whole

MODULES = (metrics, colour, edits, regions, misc, whole, finishing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
