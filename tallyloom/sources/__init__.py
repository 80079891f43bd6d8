"""Readers, writers and keyed merges."""
