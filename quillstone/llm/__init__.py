"""Operators for preparing training data: joins, packing, extraction, scoring, search.

Nothing outside this package imports it.
"""
