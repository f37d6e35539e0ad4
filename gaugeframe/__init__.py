"""Spark-native analytics for inspection data: manifests, splits, score analytics, similarity and monitoring."""
