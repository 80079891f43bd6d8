"""Operators over DataFrames: retrieval, fusion, evidence, ledgers, metrics."""
