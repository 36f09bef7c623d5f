"""Market-evidence analytics on PySpark."""
