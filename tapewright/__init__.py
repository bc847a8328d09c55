"""PySpark-native analytics over order-level market events."""
