"""Raster detection and measurement on Spark DataFrames."""
