"""Spark-native analytics for shoots: catalogs, bursts, segments, fair picks, and sinks."""
