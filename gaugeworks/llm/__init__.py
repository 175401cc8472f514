"""Operators over training text: sharding, packing, decontamination, deduplication, search, archives, counts, selection."""
