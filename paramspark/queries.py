"""The registered queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from .registry import learning, params, sketches, workers

QUERIES = params.QUERIES | sketches.QUERIES | workers.QUERIES | learning.QUERIES
ORACLE_SQL = params.ORACLE_SQL | sketches.ORACLE_SQL | workers.ORACLE_SQL | learning.ORACLE_SQL
