"""Column functions: text, sizes and parameter values."""
