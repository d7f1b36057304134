"""Every query of the relational core with its DuckDB counterpart."""

from __future__ import annotations

from bindlattice.plans import cluster_queries, extended_queries, iterative_queries, matrix_queries, scan_queries, site_queries, structure_queries

_PARTS = (matrix_queries, site_queries, structure_queries, extended_queries, iterative_queries, scan_queries, cluster_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
