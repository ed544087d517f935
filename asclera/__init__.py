"""Spark-native analytics for grounded text rewriting and for preparing training text."""

__version__ = "0.1.0"
