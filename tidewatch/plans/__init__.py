"""Queries over the given tables, each beside its SQL."""
