"""Readers, writers and the ratings / metadata views over the given tables."""
