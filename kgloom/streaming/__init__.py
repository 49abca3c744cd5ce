"""Structured Streaming forms of the indexer."""
