"""Public-procurement spend analysis as Spark jobs."""
