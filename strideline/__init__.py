"""Form analytics and corpus preparation as plain Spark DataFrame jobs."""
