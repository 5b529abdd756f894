"""Bit-level deduplication analytics on Spark DataFrames."""
