"""Ranked retrieval over text records, and its evaluation, as Spark queries."""
