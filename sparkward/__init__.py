"""Spark-native analytics over agent tool calls: detection, alert routing, event queries."""
