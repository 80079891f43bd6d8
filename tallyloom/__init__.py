"""Document-evidence analytics and training-data preparation on PySpark."""
