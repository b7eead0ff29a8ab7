"""Column functions: identity, text, numeric and JSON expressions."""
