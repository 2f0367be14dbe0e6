"""Structured Streaming twins of the time-sensitive steps."""
