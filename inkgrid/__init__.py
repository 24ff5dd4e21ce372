"""Spark-first analytics over positioned document evidence."""
