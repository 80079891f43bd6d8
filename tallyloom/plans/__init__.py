"""Composite pipelines and the read-only SQL surface."""
