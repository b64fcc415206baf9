"""Operators for training-data pipelines: cleaning, deduplication, mixing, formatting, tokens and packing.

Nothing else in the library imports this subpackage; its queries and their SQL are in ``queries``.
"""
