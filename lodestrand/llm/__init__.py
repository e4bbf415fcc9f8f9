"""Operators of a training-data pipeline: scoring, tokenizing, deduplicating, filtering.

Nothing outside this subpackage imports it.
"""
