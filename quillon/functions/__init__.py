"""Column expressions and metric functions."""
