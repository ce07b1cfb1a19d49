"""Readers, writers and the table that the registered queries start from."""
