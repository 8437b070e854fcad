"""Operators of a training-data pipeline over documents, pages and labels.

Nothing else in the library imports this package; it imports general helpers
only. One module for each operator, ``queries`` registers them.
"""
