"""Column expressions: vectors, scalars, labels."""
