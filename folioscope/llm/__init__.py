"""Operators for preparing large text corpora: mixing, deduplication, quality, archives, privacy, packing."""
