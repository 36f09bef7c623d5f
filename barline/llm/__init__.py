"""Operators of a training-data pipeline: scoring, filtering, deduplication, tokenization, search and conversations."""
