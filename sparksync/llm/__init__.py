"""Operators for training-data pipelines: filtering, dedup, tokens, scoring, search, sharding."""
