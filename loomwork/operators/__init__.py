"""Operators over a run's tables: each takes DataFrames and returns a lazy DataFrame."""
