"""Operators for preparing training text: deduplication, scoring, scanning, sharding, packing.

Nothing outside this subpackage imports it.
"""
