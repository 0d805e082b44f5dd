"""All queries of the document-perception operators, with their SQL."""

from __future__ import annotations

from .queries import Query, assets, conversion, documents, engines, layout, spans, text, web

_PARTS = (text, web, layout, assets, documents, spans, engines, conversion)

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.R.queries
    ORACLE_SQL |= _part.R.sql
