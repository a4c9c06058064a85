"""Readers, writers and the table registry."""
