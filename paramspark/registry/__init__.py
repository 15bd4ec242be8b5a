"""Registered queries by family: each module has QUERIES (name to callable) and ORACLE_SQL (name to the SQL of the same rows)."""
