"""Spark-first analytics over versioned scientific documents and their bibliographies."""
