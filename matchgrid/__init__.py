"""Spark-native analytics for match, prediction, trade and text data."""
