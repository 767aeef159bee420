"""Spark-native knowledge retrieval and conversation analytics."""
