"""Spark-native analytics over personal event histories."""
