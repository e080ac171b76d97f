"""Column expressions and number texts."""
