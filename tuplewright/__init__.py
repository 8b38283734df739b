"""Relationship analytics on Spark: one append-only change log, bulk questions over it."""
