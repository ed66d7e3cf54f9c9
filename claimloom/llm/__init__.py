"""Operators for preparing training corpora: deduplication, classification, tokenizing, scanning, search, packing."""
