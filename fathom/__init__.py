"""A Spark-native document retrieval and evaluation engine."""
