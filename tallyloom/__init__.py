"""Spark-native analytics over catalog, calendar, activity and conversation tables."""
