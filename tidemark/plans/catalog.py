"""All queries of this package by name, and their SQL."""

from tidemark.plans import assembly, assembly_sql, files, files_sql, flows, flows_sql, oracles, queries, training, training_sql

QUERIES = queries.QUERIES  # assembly, files, flows and training have added their own
SQL = oracles.SQL | assembly_sql.SQL | files_sql.SQL | flows_sql.SQL | training_sql.SQL

__all__ = ["QUERIES", "SQL", "assembly", "files", "flows", "training"]
