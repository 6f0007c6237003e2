"""Spark-native analytics for agent memory and knowledge graphs."""
