"""Column functions: normalisers and matching rules."""
