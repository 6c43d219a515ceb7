"""Operators for preparing text corpora.

Nothing outside this subpackage imports it.  Operators take and return
DataFrames; ``queries`` wraps them in the thin queries of the driver contract.
"""
