"""Analytics for large candidate-search runs, written as Spark DataFrame jobs."""
