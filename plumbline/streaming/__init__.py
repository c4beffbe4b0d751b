"""Structured Streaming forms of analyses."""
