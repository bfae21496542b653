"""koewake: a Spark-native engine that curates corpora of speech recordings."""

__version__ = "0.1.0"
