"""Transformations: DataFrames in, DataFrames out."""
