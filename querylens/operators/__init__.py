"""Operators over DataFrames: gates, groups, aggregates, ranking, inference, retrieval."""
