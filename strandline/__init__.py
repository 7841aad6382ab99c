"""strandline: annotated-sequence analytics and training-data operators on PySpark."""
