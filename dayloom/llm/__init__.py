"""Operators of a training-data pipeline: deduplication, filters, classifiers, search, mixing and token output.

Nothing else in the library imports this package.
"""
