"""Column functions: texts, claims, numbers."""
