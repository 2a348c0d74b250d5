"""A PySpark-native engine for stream deduplication, compression and similarity search."""

__version__ = "0.1.0"
