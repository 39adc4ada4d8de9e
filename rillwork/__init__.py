"""rillwork: a Spark-native engine for data preparation, privacy and streaming analytics."""

__version__ = "0.1.0"
