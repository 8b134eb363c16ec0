"""A PySpark-native engine for preparing, ranking, checking and measuring text data."""
