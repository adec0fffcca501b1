"""Relational and statistical operators: DataFrames in, DataFrames or small fixed-layout vectors out."""
