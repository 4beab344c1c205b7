"""Spark-native operators over subtitle, transcript and dubbing tables."""
