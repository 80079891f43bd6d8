"""Stateful and streaming operators, each with a batch twin."""
