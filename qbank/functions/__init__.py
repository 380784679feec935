"""Column functions: text, similarity, geometry, status."""
