"""Spark-native analytics for tiled images, vector geometry and text corpora."""
