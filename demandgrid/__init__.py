"""Spark-native site-demand analytics: DataFrame operators over class history,
ZIP signals, points of interest and operations tables."""
