"""Column expressions and fixed label lists."""
