"""Structuring of book and document corpora on Spark DataFrames."""
