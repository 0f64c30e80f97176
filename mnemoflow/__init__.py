"""Spark-first text-memory retrieval and evaluation engine."""

__version__ = "0.1.0"
