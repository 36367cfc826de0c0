"""Tidemark: a PySpark-native analytics engine for timestamped, optionally located item collections."""
