"""Operators for preparing training text: archives, formatting, deduplication, packing."""
