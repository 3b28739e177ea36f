"""Spark-native engine for building, searching and evaluating a citable knowledge base."""
