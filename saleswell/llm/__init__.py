"""Operators for training-data pipelines: packing, scoring, search, deduplication, filtering, formatting, tokenising."""
