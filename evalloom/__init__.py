"""Spark-native analytics for long-document question-answering evaluations."""
