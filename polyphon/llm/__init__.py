"""Operators of a training-data pipeline: dedup, search, packing, scans, scoring, token files."""
