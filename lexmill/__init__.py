"""Spark-first corpus and discourse analytics."""

__version__ = "0.1.0"
