"""Granary: a Spark-first engine for document preparation and analytics."""
