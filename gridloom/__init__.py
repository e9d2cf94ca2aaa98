"""Raster and point statistics on equal-area grid cells, as Spark DataFrame plans."""
