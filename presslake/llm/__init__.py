"""Operators of a training-data pipeline: deduplication, mixing, packing, scoring, search and chat rendering."""
