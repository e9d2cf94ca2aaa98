"""Registered queries of the raster engine and their SQL for DuckDB."""

from gridloom import queries, raster_queries

QUERIES = queries.QUERIES
ORACLES = raster_queries.ORACLES
