"""Reliability analytics on Spark."""
