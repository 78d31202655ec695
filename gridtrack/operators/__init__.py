"""Operators on fields and objects, DataFrame to DataFrame."""
