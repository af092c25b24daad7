"""Whole-table operators; each takes and returns DataFrames."""
