"""Incremental matching of arriving images against a stored repository."""
