"""Property-listing analytics as Spark DataFrame jobs."""
