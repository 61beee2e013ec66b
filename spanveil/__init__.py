"""Distributed text matching, coverage and redaction on Spark DataFrames."""
