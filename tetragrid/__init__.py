"""Spark-native analytics over chaos-game representations of symbol sequences."""
