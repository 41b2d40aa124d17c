"""Review analytics as plain PySpark DataFrame operations."""
