"""Operators for preparing training data: packing, scans, deduplication, scoring, indexing."""
