"""Operators on DataFrames: rules, state, distance, similarity, clustering, ranking."""
