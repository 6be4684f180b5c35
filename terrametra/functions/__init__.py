"""Column helpers: numbers, geometry, text and fixed value lists."""
