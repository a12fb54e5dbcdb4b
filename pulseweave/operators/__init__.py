"""Operators: every function takes and returns DataFrames and runs no job by itself."""
