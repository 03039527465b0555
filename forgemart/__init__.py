"""Production-control analytics as Spark DataFrame jobs."""
