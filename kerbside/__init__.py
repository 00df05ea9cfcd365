"""Spark-native analytics for geotagged street-level imagery and its descriptions."""

__version__ = "0.1.0"
