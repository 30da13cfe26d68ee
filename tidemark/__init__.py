"""Conversational-retrieval analytics on Spark: DataFrame operators, sources, queries and streams."""
