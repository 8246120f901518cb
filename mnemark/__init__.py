"""Spark-native recall, entity-graph and training-data analytics over personal-archive tables."""
