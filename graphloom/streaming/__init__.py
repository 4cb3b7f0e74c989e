"""Incremental (Structured Streaming) entry points."""
