"""Operators for preparing training data: quality, extraction, dedup, search, mixing, packing, scans.

Nothing else in the library imports this subpackage.
"""
