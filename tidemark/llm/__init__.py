"""Operators for building training-data corpora.

Nothing outside this subpackage imports it; it can be removed without touching the rest.
"""
