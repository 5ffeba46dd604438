"""Retrieval analytics over documents and slides, expressed in Spark DataFrames."""
