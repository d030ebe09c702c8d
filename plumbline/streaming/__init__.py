"""Structured Streaming jobs over audit events."""
