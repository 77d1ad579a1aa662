"""A PySpark-native engine for entity-by-week panels."""
