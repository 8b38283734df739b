"""Bulk operators over edges, tuples, logs and keyed tables."""
