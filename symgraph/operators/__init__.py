"""Operators over the graph's tables. They take and return DataFrames."""
