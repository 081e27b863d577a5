"""tidemark: posting analytics and corpus preparation as plain Spark jobs."""
