"""Column expressions and their fixed values."""
