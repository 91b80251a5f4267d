"""Spark-native signal analytics: metrics over sampled signals and the data-preparation operators around them."""

__version__ = "0.2.0"
