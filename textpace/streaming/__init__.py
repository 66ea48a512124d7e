"""Structured Streaming forms of the session analytics."""
