"""Column expressions and value functions."""
