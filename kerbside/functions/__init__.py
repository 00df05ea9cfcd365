"""Column expressions: geometry, text, vectors."""
