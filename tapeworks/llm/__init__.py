"""Corpus operators for training data: deduplication, search, tagging, tokenising and sharding."""
