"""Corpus-to-knowledge-graph retrieval as plain Spark DataFrame operations."""
