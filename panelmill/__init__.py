"""Panel analytics and data preparation expressed as Spark DataFrame jobs."""
