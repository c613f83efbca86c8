"""Spark-first analytics for span detection measurements and training-data tables."""
