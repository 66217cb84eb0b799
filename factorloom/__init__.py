"""Equity factor-risk analytics on Spark DataFrames."""
