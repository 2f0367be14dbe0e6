"""Readers that turn vendor tables and raw events into bars and daily metrics, and the sinks."""
