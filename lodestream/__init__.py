"""A PySpark-native engine for personalization analytics."""
