"""Operators for large-scale training-data preparation; nothing else in the library imports this package."""
