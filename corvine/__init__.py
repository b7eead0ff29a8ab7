"""Corvine: a Spark-native engine for corpus analytics and hybrid retrieval."""
