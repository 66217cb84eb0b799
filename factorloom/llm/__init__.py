"""Operators of a training-data pipeline: scoring, filtering, deduplication, encoding.

Nothing else in the library imports this subpackage.
"""
