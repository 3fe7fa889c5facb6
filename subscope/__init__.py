"""Customer analytics for subscription businesses, written as Spark jobs."""
