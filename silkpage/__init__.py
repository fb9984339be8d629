"""Spark-native analytics over captured web pages."""
