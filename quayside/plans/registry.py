"""Every registered query of the catalogue's kind, and its SQL."""

from quayside.plans import catalogue_queries, event_queries, function_queries, page_queries, price_queries, report_queries, text_queries

MODULES = (price_queries, text_queries, catalogue_queries, event_queries, report_queries, function_queries, page_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
