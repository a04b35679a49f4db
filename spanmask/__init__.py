"""Personal-data redaction, and training-data operators, as PySpark jobs."""
