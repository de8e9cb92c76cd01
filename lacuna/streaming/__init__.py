"""Structured Streaming forms of updates, progress and logs."""
