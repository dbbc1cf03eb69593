"""Readers, writers and validation of book documents."""
