"""Spark-native transcript isoform analytics."""
