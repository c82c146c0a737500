"""Spark-first engine for structured document collections."""
