"""Layered raster images as relational data, on Spark."""
