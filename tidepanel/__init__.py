"""Spark-native analytics for daily entity panels."""
