"""Catalog and query operators over Spark DataFrames."""
