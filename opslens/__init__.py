"""Spark-native analytics over infrastructure logs and metrics."""
