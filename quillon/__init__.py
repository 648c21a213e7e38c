"""A PySpark-native engine for directory-style contact data."""
