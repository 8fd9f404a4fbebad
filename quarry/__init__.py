"""Spark-native analytics and data-mining engine."""
