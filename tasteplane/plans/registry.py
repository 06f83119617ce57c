"""Every registered query of the library with its DuckDB oracle."""

from __future__ import annotations

from tasteplane.plans import queries_catalog, queries_library, queries_models

QUERIES: dict = {**queries_library.QUERIES, **queries_catalog.QUERIES, **queries_models.QUERIES}
ORACLES: dict = {**queries_library.ORACLES, **queries_catalog.ORACLES, **queries_models.ORACLES}
