"""Column expressions: text, features, numbers."""
