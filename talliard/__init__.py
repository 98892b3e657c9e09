"""Usage analytics and corpus preparation as Spark DataFrame code."""
