"""Operators for building training corpora: deduplication, filtering, tokens and mixing."""
