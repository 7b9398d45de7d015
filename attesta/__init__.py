"""Citation-attribution analytics on Spark."""
