"""Spatial and spatio-temporal point-pattern analytics on Spark DataFrames."""
