"""Hydroclimate analytics on Spark DataFrames."""
