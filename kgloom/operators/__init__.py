"""Operators: DataFrames in, DataFrames out, without actions inside unless said so."""
