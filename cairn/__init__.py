"""Analytical SQL and data processing expressed with Spark's DataFrame and SQL APIs."""
