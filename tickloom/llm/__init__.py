"""Operators for training-data pipelines: deduplication, packing, formatting, tokens, extraction, quality and search."""
