"""Column functions: box geometry and text rules."""
