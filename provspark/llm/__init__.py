"""Operators of a training-data pipeline: extraction, filtering, near-duplicates, leaks, secrets, scoring, shards."""
