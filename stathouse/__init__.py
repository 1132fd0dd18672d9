"""A PySpark-native analytics engine for event-level data."""
