"""Spark-native operators over change logs, content-addressed chunks and their metadata."""
