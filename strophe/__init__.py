"""Analytics for annotated sequences, written as ordinary Spark DataFrame jobs."""
