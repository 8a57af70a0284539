"""All registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from .plans import document_queries, library_queries, record_queries, stream_queries, text_queries
from .plans.views import Query

QUERIES: dict[str, Query] = text_queries.QUERIES | document_queries.QUERIES | library_queries.QUERIES | record_queries.QUERIES | stream_queries.QUERIES
ORACLES: dict[str, str] = text_queries.ORACLES | document_queries.ORACLES | library_queries.ORACLES | record_queries.ORACLES | stream_queries.ORACLES
