"""Group scoring, curation and evaluation analytics on PySpark."""
