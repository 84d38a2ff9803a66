"""Catalog operators: metrics, filters, ranking, merging, geography, checks and progress."""
