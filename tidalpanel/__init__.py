"""Spark-native analytics for panels of periodic time series."""
