"""Readers and writers for profiles, traces, records and source text."""
