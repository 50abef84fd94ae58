"""Structured Streaming forms of the time operators."""
