"""A Spark-native evidence and analytics engine."""
