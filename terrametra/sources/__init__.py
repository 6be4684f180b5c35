"""Readers and writers: registries, archives, layouts, listings, postal index, account tables."""
