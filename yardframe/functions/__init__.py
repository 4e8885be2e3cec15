"""Column expressions with the null rules of the analyses."""
