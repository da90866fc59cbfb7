"""Operators that prepare text corpora: sharding, decontamination, scans, deduplication, mixing and quality."""
