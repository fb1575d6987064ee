"""A Spark-native engine for preparing text corpora."""
