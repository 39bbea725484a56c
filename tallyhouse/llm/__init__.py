"""Operators for preparing training data: mixing, tokenizing, extraction, deduplication, scoring and search."""
