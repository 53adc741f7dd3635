"""Operators: each takes and returns columns or DataFrames."""
