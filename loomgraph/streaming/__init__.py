"""Incremental forms of the merge operators."""
