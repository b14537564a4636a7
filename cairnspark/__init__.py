"""Versioned, content-addressed data analytics on Spark DataFrames."""
