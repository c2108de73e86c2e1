"""Relational operators over panels. Each takes and returns DataFrames."""
