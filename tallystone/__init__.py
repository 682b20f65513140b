"""Company filing analytics as Spark DataFrame jobs."""
