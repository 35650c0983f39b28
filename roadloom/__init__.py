"""Pavement survey analytics as Spark DataFrame jobs."""
