"""Retail growth analytics as Spark DataFrame jobs."""
