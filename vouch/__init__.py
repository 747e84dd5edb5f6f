"""Verified insights over any Spark table."""
