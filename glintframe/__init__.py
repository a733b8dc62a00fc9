"""Spark-native operators for dense video, traces and text corpora."""
