"""Column-to-Column expressions."""
