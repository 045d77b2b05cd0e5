"""All queries of the health-record jobs, with their SQL where SQL can express them."""

from __future__ import annotations

from caretrail.plans import backup_queries, merge_queries, rule_queries, scalar_queries, store_queries, text_queries, view_queries

_MODULES = [scalar_queries, merge_queries, view_queries, text_queries, store_queries, rule_queries, backup_queries]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
