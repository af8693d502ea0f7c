"""Trade-network analytics on Spark."""
