"""Operators for preparing training corpora: each is a function from DataFrames to a DataFrame."""
