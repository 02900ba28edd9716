"""Operators of a training-data pipeline over document and page tables.

Nothing else in the library imports this subpackage.
"""
