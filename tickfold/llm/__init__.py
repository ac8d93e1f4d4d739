"""Operators on training text: filters, deduplication, formatting, packing."""
