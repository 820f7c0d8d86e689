"""Type-checking and lowering."""
