"""Operators on DataFrames of cells, paths, rings, points and pixels."""
