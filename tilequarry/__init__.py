"""Tiled-image and annotation analytics, and training-data preparation, on Spark."""
