"""Summaries and served look-ups as DataFrames."""
