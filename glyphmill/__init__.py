"""Spark-native analytics for source-code and text corpora."""
