"""Spark-native analytics over point clouds and other relations."""
