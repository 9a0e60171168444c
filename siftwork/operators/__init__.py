"""Relational, ordered, graph and similarity operators on DataFrames."""
