"""All queries of the library, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from purseflow.plans import check_queries, identity_queries, ledger_queries, matching_queries, source_queries, view_queries

_MODULES = (ledger_queries, view_queries, matching_queries, check_queries, source_queries, identity_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
