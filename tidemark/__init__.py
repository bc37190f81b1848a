"""Tidemark: event-stream analytics on Spark."""
