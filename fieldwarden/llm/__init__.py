"""Corpus operators for training data: extraction, filtering, deduplication, mixing and tokens."""
