"""Title catalog, search, label prediction and statistics as Spark DataFrame jobs."""
