"""All queries of the reconciliation library and the SQL that checks them."""

from __future__ import annotations

from . import change_queries, compliance_queries, extract_queries, item_queries, leftover_queries, matching_queries, payload_queries, queue_queries, record_queries, request_queries, resolve_queries, source_queries, statistics_queries

MODULES = (matching_queries, compliance_queries, resolve_queries, leftover_queries, payload_queries, extract_queries, change_queries, queue_queries, item_queries, source_queries, request_queries, record_queries, statistics_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
