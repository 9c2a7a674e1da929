"""Quellwerk: Spark-native retrieval and analytics over semi-structured text reports."""
