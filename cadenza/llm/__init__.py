"""Operators for large text corpora: search, cleaning, deduplication, tokens, packing, media."""
