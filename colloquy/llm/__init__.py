"""Operators that prepare training corpora: near-duplicates, quality, sharding, tokens, packing.

Nothing else in the library imports this subpackage.
"""
