"""Column functions: vectors, text and scalars."""
