"""Registered queries over the driver's tables, and the SQL each is checked against."""

from nestfold.catalog import ingest_queries, listing_queries, match_queries, state_queries

MODULES = [listing_queries, ingest_queries, state_queries, match_queries]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in MODULES for name, q in m.ORACLE.items()}
