"""Operators for preparing training data: filtering, joins, packing and search over document tables.

Nothing outside this package imports it; the package can be removed whole.
"""
