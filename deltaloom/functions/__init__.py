"""Column expressions: regular-expression dialect, type names, normalisation and match predicates."""
