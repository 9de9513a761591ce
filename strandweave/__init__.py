"""Spark-native analytics of sequence collections as reference structures."""
