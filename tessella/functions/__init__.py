"""Column functions: text, sets, keys."""
