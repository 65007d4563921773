"""Energy-system data engine expressed as Spark DataFrame jobs."""
