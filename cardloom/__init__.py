"""Memory-card analytics on Spark DataFrames."""
