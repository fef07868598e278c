"""Spark-native operators for curating, grading and profiling reasoning corpora."""
