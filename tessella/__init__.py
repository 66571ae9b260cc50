"""A PySpark library for data work on question and answer logs and their problem tables."""
