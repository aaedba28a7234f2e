"""Spark-native analysis, lossless compression, verification and preview of raw camera frames."""
