"""whinstone: a Spark-native hybrid retrieval, evaluation and corpus engine."""

__version__ = "0.1.0"
