"""All queries by name, with SQL for those that SQL can express."""

from __future__ import annotations

from . import activity, browse, candidates, history, ledger, predicates, retrieval, sources, texts, writes

MODULES = (activity, browse, history, ledger, retrieval, texts, predicates, writes, candidates, sources)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
