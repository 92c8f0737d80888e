"""Cost-sensitive inspection analytics on Spark."""
