"""Keyed records on Spark: logs, line files and sorted tables as DataFrames."""
