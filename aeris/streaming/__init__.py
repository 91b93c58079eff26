"""Structured Streaming forms of the live view."""
