"""Operators and queries for training data: cleaning, deduplication and tokenizing of documents.

Nothing else in the library imports this package.
"""
