"""Operators on whole tables: each takes and returns DataFrames."""
