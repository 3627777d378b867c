"""Operators of a training-data pipeline: near-duplicates, filters, tokens, archives.

Nothing else in the library imports this subpackage.
"""
