"""Operators for preparing text corpora: dedup, sharding, packing, filters, extraction.

Nothing else in the library imports this subpackage.
"""
