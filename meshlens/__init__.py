"""Service-dependency analytics expressed as Spark DataFrame jobs."""
