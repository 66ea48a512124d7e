"""Scans, derived inputs and sinks."""
