"""Operators that prepare training text: deduplication, filtering, scanning, mixing and vector search.

Nothing outside this folder imports it.
"""
