"""Column expressions: vectorising, quantising, distances."""
