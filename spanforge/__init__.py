"""Spark operators for entity-resolved, time-aware event data."""
