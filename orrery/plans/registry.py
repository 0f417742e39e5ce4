"""Every registered query of the core, with the SQL that checks it."""

from __future__ import annotations

from orrery.plans import queries_composed, queries_extra, queries_grids, queries_more, queries_relational, queries_spatial, queries_streams  # noqa: F401  they register themselves
from orrery.plans.tables import ORACLE_SQL, QUERIES, Tables, query

__all__ = ["ORACLE_SQL", "QUERIES", "Tables", "query"]
