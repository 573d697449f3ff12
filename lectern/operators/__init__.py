"""Relational and retrieval operators on DataFrames."""
