"""Spark-native analytics over property graphs of software facts, and data-preparation operators."""

__version__ = "0.1.0"
