"""Batch operators: each takes DataFrames and plain specs and returns a lazy DataFrame."""
