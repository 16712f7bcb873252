"""A Spark-native engine that treats a source tree as data."""
