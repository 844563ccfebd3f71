"""Case-record and civic-data analytics as PySpark DataFrame operations."""
