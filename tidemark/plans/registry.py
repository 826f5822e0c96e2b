"""All queries of the engine with their DuckDB equivalents."""

from __future__ import annotations

from . import queries as _queries
from . import source_queries as _sources  # these register their own beside them
from . import stream_queries as _streams
from . import table_queries as _tables

assert _sources and _streams and _tables


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.SQL)
