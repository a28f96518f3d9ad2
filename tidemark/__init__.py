"""Spark-native marine notice and map-layer analytics."""
