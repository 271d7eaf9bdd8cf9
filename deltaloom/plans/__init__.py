"""Whole plans: the comparison and the query catalogue."""
