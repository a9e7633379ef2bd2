"""Operators over annotated matrices: DataFrames in, DataFrames out."""
