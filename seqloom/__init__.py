"""Spark-native analytics for long noisy sequences, plus corpus operators in ``llm``."""
