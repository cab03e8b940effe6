"""Operators for building training corpora: filtering, scanning, deduplicating, scoring and packing documents."""
