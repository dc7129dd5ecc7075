"""Column expressions: geometry, tapers, basis functions."""
