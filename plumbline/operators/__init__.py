"""Operators: every function takes DataFrames and returns a lazy DataFrame keyed by columns, never by position."""
