"""Spark-native document, graph and retrieval operators."""
