"""All queries of the property-media operators, and their SQL."""

from propflow.plans import asset_queries, document_queries, file_queries, production_queries, rule_queries

QUERIES = asset_queries.QUERIES | document_queries.QUERIES | file_queries.QUERIES | production_queries.QUERIES | rule_queries.QUERIES
SQL = asset_queries.SQL | document_queries.SQL | file_queries.SQL | production_queries.SQL | rule_queries.SQL
