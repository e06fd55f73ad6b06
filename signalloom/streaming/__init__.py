"""Structured Streaming forms of the arrival-time operators."""
