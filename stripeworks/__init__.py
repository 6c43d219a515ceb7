"""Road-marking analytics on Spark."""
