"""Operators for preparing training data: deduplication, filtering, search, packing, tokens."""
