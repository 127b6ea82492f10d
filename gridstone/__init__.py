"""Spark-native race and news analytics."""
