"""Operators for training-data pipelines: cleaning, privacy, deduplication, tokens, packing and search."""
