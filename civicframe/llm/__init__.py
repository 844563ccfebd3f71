"""Operators that prepare training data: dedup, scoring, mixing, packing, scans and sharding."""
