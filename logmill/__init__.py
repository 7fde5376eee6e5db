"""Spark-native processing of addressed message logs and of training-text tables."""

__version__ = "0.1.0"
