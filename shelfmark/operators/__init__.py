"""Operators on catalogs, resources, files and leaves; DataFrames in, DataFrames out."""
