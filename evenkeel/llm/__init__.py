"""Operators for training-data pipelines over document and page tables.

Nothing else in the library imports this subpackage.
"""
