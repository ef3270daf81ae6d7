"""Spark-native operators for large per-object measurement tables and their labels."""

__version__ = "0.1.0"
