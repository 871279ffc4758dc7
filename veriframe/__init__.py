"""Identity-verification analytics as Spark DataFrame jobs."""
