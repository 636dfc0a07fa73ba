"""Structured Streaming forms of the hourly statistics."""
