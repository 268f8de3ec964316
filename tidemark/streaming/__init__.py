"""Structured Streaming forms of the late-data rules."""
