"""Operators for large-scale training-data pipelines; nothing outside this package imports it."""
