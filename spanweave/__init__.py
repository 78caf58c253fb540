"""Spark-native evaluation of how a corpus should be split for retrieval."""
