"""Customer-feedback analytics as lazy Spark DataFrame jobs."""
