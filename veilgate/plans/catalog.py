"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from veilgate.plans import (
    index_queries,
    search_oracles,
    search_queries,
    service_oracles,
    service_queries,
    stream_oracles,
    stream_queries,
    text_oracles,
    text_queries,
)

_QUERIES = (text_queries, search_queries, service_queries, stream_queries, index_queries)
_ORACLES = (text_oracles, search_oracles, service_oracles, stream_oracles, index_queries)

QUERIES = {name: query for module in _QUERIES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _ORACLES for name, sql in module.ORACLES.items()}
