"""Spark-native analytics for reasoning traces, their scores and the corpora around them."""

__version__ = "0.1.0"
