"""Retrieval, evaluation and comparison operators."""
