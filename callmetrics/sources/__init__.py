"""Readers, schemas and table adapters."""
