"""Visual-anomaly analytics as Spark jobs."""
