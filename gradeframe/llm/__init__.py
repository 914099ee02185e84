"""Operators for large training-data pipelines: deduplication, decontamination, filters, packing, scoring.

Nothing else in the library imports this package.
"""
