"""Column expressions: rounding, text, addresses, similarity, JSON and dates."""
