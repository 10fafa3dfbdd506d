"""Spark-native analytics over document corpora, their histories and graphs."""
