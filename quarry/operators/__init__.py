"""Operators of the retrieval engine, each from DataFrames to a DataFrame."""
