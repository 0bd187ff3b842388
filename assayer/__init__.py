"""Data quality, redaction and catalogue governance as Spark jobs."""
