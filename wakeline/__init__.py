"""wakeline: vessel-track analytics and corpus operators expressed as Spark jobs."""
