"""Spark-native analytics over source-code dependency graphs."""
