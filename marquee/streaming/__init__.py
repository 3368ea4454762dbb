"""Structured Streaming forms of the live paths."""
