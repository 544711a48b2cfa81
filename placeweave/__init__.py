"""Spark-native engine for geo-located business directories."""
