"""Retrieval and knowledge-graph analytics on Spark DataFrames."""
