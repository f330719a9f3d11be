"""Column expressions, window builders and grouped recursions."""
