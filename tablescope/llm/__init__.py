"""Operators for large training-data pipelines, with the queries that apply them to the given tables."""
