"""Raster files, projections, connectors and sinks."""
