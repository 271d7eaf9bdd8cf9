"""Relational steps of the comparison: alignment, integrity checks and joins."""
