"""Queries: operators applied to concrete tables."""
