"""Operators of large-scale training-data preparation.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
