"""Spark-native curation, profiling and evaluation of labelled text collections."""
