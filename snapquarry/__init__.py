"""Spark-native analytics for deduplicating, point-in-time snapshot catalogs."""
