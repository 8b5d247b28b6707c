"""Spark-first analytics for retail data, reporting patterns and text corpora."""
