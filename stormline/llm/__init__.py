"""Operators for training-data pipelines: deduplication, filtering, mixing, tokens and formats."""
