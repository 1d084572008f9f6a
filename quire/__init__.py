"""quire: document-tree analytics as PySpark DataFrame jobs."""
