"""Web search and analytics on Spark."""
