"""Subword analytics on Spark."""
