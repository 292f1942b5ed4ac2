"""Structured Streaming forms of the online detectors."""
