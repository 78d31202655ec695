"""Structured Streaming forms; extensions."""
