"""Readers, writers and constraint checks."""
