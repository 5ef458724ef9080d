"""Prose-lint analytics and training-data operators on PySpark."""

__version__ = "0.3.0"
