"""Readers and writers of the catalog's files."""
