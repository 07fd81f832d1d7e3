"""Spark-native search and ranking analytics."""

__version__ = "0.1.0"
