"""A Spark-native engine for dense volumes, the key-point features derived from them, and their matching."""
