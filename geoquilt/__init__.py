"""Spark-native geometric analytics: DataFrame -> DataFrame operators."""
