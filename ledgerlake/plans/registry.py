"""All registered queries of the filing operators and their oracles."""

from __future__ import annotations

from . import chinese_queries, line_queries, more_queries, page_queries, review_queries, source_queries, statement_queries, xbrl_queries

_MODULES = (xbrl_queries, review_queries, page_queries, line_queries, more_queries, statement_queries, chinese_queries, source_queries)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
