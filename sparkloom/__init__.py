"""Spark-native text tokenization, detokenization and token analytics."""

__version__ = "0.1.0"
