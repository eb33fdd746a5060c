"""Operators of a training-data pipeline: deduplication, filtering, extraction, tokenising and sharding.

Nothing else in the library imports this subpackage.
"""
