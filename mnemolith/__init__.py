"""Spark-native analytics over the memory of AI agents."""

__version__ = "0.1.0"
