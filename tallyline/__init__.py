"""Ordered two-participant contest analytics on Spark."""
