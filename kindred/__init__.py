"""Spark-native rule-based entity resolution."""
