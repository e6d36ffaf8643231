"""Engram: a Spark-native engine for short, expiring text records and corpus preparation."""
