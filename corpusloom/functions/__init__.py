"""Column expressions on texts and paths."""
