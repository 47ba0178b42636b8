"""Retrieval analytics over code and document corpora, built on Spark DataFrames."""
