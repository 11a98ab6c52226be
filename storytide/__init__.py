"""Narrative analytics on Spark: theme trends, narrative density, bursts, review and board operators."""
