"""Operators that prepare training text: formatting, filtering, deduplication, scoring and encoding."""
