"""Operators of a training-data pipeline: search, filters, duplicates, scoring, packing, tokens."""
