"""Operators for preparing training corpora: counting, deduplicating, filtering, formatting, packing."""
