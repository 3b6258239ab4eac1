"""Spark-native engine for keyed, versioned records and ranked retrieval over them."""

__version__ = "0.1.0"
