"""Composite documents and the query catalogue."""
