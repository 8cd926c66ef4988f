"""Matching operators: pair scoring, similarity join, exact-value groups, search, grouping."""
