"""Conversational-memory analytics on Spark: retrieval, social graph, life cycle, activity."""
