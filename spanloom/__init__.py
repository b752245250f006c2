"""Spark-native analytics over sensitive text: detection, resolution, rewriting, and the evaluation of all three."""
