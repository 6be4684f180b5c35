"""Analytical compositions, test-table bindings and the query registry."""
