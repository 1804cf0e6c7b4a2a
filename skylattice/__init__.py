"""Dataset construction and retrieval analytics on PySpark."""
