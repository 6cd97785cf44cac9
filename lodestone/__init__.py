"""Lodestone: a Spark-native retrieval, graph and text analytics engine."""
