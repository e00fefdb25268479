"""Spark-native analytics for an image-sharing community, with a subpackage for training-data pipelines."""
