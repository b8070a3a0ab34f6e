"""Readers and writers with explicit schemas and good/bad splits."""
