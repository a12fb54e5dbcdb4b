"""Readers for clinical tables, recording headers and code files; dataset sinks."""
