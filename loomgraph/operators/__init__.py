"""Operators over entity and relation DataFrames."""
