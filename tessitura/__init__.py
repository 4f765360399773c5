"""A PySpark-native engine for preparing, checking and scoring token-sequence datasets."""
