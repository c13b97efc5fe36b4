"""Exact, selective retrieval over typed tables on Spark."""
