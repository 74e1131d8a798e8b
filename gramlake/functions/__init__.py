"""Column expressions and their numpy twins."""
