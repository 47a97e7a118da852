"""Institutional early-warning and open-source-event analytics on Spark DataFrames."""
