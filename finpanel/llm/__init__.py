"""Operators that prepare training text: extraction, filtering, deduplication, mixing, formatting."""
