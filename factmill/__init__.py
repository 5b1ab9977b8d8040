"""Spark-native analytics for sourced facts."""
