"""Curated-catalog analytics on Spark."""
