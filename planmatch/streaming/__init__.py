"""Keyed job state and permit numbers under Structured Streaming."""
