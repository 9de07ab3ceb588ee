"""Operators that prepare training text: deduplication, rules, counts, encoding and packing.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
