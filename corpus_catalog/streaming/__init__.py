"""Continuous builds with Structured Streaming."""
