"""Column expressions: text, identifiers, ages and classes."""
