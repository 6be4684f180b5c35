"""Structured Streaming forms of the stateful counters."""
