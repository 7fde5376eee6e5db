"""The core's registry: name to (Spark query, SQL)."""

from __future__ import annotations

from logmill import queries_data, queries_log

QUERIES = {**queries_log.QUERIES, **queries_data.QUERIES}
SQL = {**queries_log.SQL, **queries_data.SQL}
