"""Column functions: text, values and p-values."""
