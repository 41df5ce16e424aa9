"""Readers, writers and the domain views of the given tables."""
