"""Operators of a training-data pipeline: packing, mixing, deduplication, extraction, scoring, search and sharding."""
