"""Data operators of a collaborative knowledge base, as Spark DataFrame jobs."""
