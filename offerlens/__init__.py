"""Procurement analytics as ordinary Spark DataFrame, SQL and Structured Streaming plans."""
