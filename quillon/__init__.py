"""quillon: a Spark-native engine for text collections."""

__version__ = "0.1.0"
